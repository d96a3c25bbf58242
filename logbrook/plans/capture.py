"""End-to-end plans: capture sessions into bundles, preview, inspect, verify, and the gate to prepare.

A capture writes a table after each step, so that the 25-pass fold stands in one plan once.
"""

from __future__ import annotations

import json
import platform
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .. import schemas
from ..errors import SourceError
from ..functions.json_leaves import redact_json
from ..functions.patterns import Registry
from ..functions.policy import MAX_EVIDENCE
from ..functions.redact import new_salt, redact, unresolved_high
from ..functions.text import basename
from ..operators import events, incidents, manifest, report
from ..operators import verify as checks
from ..sources import archives
from ..sources.sessions import MANIFEST_AGENT, connector
from ..sources.working import Working
from .workspace import git_state


def environment() -> dict[str, str]:
    """Facts of this machine that are safe to share; the host's name is not."""
    return {"os": platform.system(), "os_version": platform.release(), "machine": platform.machine(), "python_version": platform.python_version(), "hostname": "redacted"}


def evidence(files: DataFrame, *keys: str) -> DataFrame:
    """The first files by path as evidence/evidence_NNN.txt, and an index of their base names.

    files: keys, path, content (binary).  The limit belongs to the format.
    """
    rows = files.withColumn("n", F.row_number().over(W.partitionBy(*keys).orderBy("path"))).where(F.col("n") <= MAX_EVIDENCE)
    name = F.concat(F.lit("evidence_"), F.lpad(F.col("n").cast("string"), 3, "0"), F.lit(".txt"))
    rows = rows.select(*keys, name.alias("_file"), basename(F.col("path")).alias("_from"), F.make_valid_utf8(F.col("content").cast("string")).alias("text"))
    each = rows.select(*keys, F.concat(F.lit("evidence/"), "_file").alias("path"), F.lit("evidence").alias("role"), "text")
    listed = F.array_sort(F.collect_list(F.struct(F.col("_file").alias("file"), F.col("_from").alias("source"))))
    index = rows.groupBy(*keys).agg(F.to_json(F.struct(listed.alias("files"))).alias("text"))
    return each.unionByName(index.select(*keys, F.lit("evidence/index.json").alias("path"), F.lit("evidence_index").alias("role"), "text"))


def session_lines(events_: DataFrame) -> DataFrame:
    """session_id, path, role, seq, line: the session as JSON Lines, one row a line."""
    return events.to_jsonl(events_).select("session_id", F.lit("session.jsonl").alias("path"), F.lit("session").alias("role"), "seq", "line")


def redact_files(files: DataFrame, salt: str | None = None, registry: Registry | None = None) -> DataFrame:
    """files (…, path, text) with redacted, changes and what a second scan still finds."""
    out = redact(files, "text", "redacted", registry, salt, changes="changes")
    return out.withColumn("unresolved", unresolved_high(F.col("redacted"), registry))


def redact_lines(lines: DataFrame, salt: str | None = None, registry: Registry | None = None) -> DataFrame:
    """Lines of JSON (session_id, path, role, seq, line) as files with redacted leaves, in the columns of redact_files."""
    done = redact_json(lines, "line", ["session_id", "path", "seq"], salt, registry, F.row_number().over(W.partitionBy("session_id", "path").orderBy("seq")))
    order = F.array_sort(F.collect_list(F.struct("seq", "line", "redacted", "changes", "unresolved")))
    files = done.groupBy("session_id", "path", "role").agg(order.alias("x"))
    end = F.when(F.col("path").endswith(".jsonl"), "\n").otherwise("")
    text = lambda c: F.concat(F.array_join(F.transform("x", lambda r: r[c]), "\n"), end)
    left = F.aggregate("x", F.lit(0).cast("long"), lambda n, r: n + r["unresolved"])
    return files.select("session_id", "path", "role", text("line").alias("text"), text("redacted").alias("redacted"), F.flatten(F.transform("x", lambda r: r["changes"])).alias("changes"), left.alias("unresolved"))


def split_payload(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """files (…, content as binary) that are text (…, text), and the others; only texts can be redacted."""
    text = F.col("content").cast("string")
    rows = files.withColumn("_text", F.is_valid_utf8(text))
    return rows.where("_text").drop("_text").withColumn("text", text).drop("content"), rows.where("not _text").drop("_text")


def preview(files: DataFrame, salt: str | None = None, *keys: str) -> DataFrame:
    """Totals, risk and whether an export is blocked, per bundle."""
    return report.preview(report.inventory(redact_files(files, salt), "path", "text", *keys), *keys)


def capture(
    spark: SparkSession, agent: str, home: str, selector: str, folder: str, extra: DataFrame | None = None, salt: str | None = None, allow_blocked: bool = False, registry: Registry | None = None,
    incident: DataFrame | None = None, evidence_files: DataFrame | None = None, repository: str | None = None, schemas_from: str | None = None,
) -> DataFrame:
    """Bundles of the selected sessions; rows (bundle_id, path, bytes, sha256).

    extra: session_id, path, role and text, or content in bytes (bytes that are no UTF-8 are taken as they
    are); incident: session_id, value (a record that passes the gate); evidence_files: session_id, path,
    content; repository: a folder on the driver whose git state is noted; schemas_from: a folder with schemas.
    Sessions whose preview blocks the export are left out unless allowed.  JSON is redacted leaf by leaf.
    """
    salt = salt or new_salt()
    work = Working(spark, "capture")
    source = connector(spark, agent, home)
    sessions = work.keep(source.discover(selector))
    if not sessions.take(1):
        raise SourceError(f"No session of {agent} fits '{selector}'", "E_SOURCE")
    lines = work.keep(session_lines(source.read(sessions)))
    counted = lines.groupBy("session_id").agg(F.count(F.lit(1)).alias("event_count"))
    meta = sessions.select("session_id", "source_format").join(counted, "session_id", "left")
    known = F.struct("session_id", F.coalesce("event_count", F.lit(0)).alias("event_count"), "source_format")
    one = lambda rows, path, role, line: rows.select("session_id", F.lit(path).alias("path"), F.lit(role).alias("role"), F.lit(0).cast("long").alias("seq"), line.alias("line"))
    state = git_state(repository)
    json_lines = [lines, one(meta, "session-metadata.json", "session_metadata", F.to_json(known)), one(sessions, "environment.json", "environment", F.lit(json.dumps(environment())))]
    if state:
        json_lines.append(one(sessions, "git-state.json", "git_state", F.lit(json.dumps(state))))
    told = None
    if incident is not None:
        records = incident.join(sessions.select("session_id"), "session_id", "left_semi").where(incidents.gate(F.col("value")).isNull()).withColumn("v", F.parse_json("value"))
        got = incidents.getters(F.col("v"))
        told = work.keep(records.select("session_id", F.to_json(incidents.project(F.col("v"))).alias("line"), got["incident_id"].alias("incident_id"), got["producer"].alias("incident_producer")))
        json_lines.append(one(told, "incident.json", "incident", F.col("line")))
    done = redact_lines(_all(json_lines), salt, registry)
    texts, raw = [], None
    if evidence_files is not None:
        wanted = evidence_files.join(sessions.select("session_id"), "session_id", "left_semi")
        texts.append(evidence(wanted, "session_id").select("session_id", "path", "role", "text"))
    if extra is not None:
        plain = extra if "text" in extra.columns else None
        if plain is None:
            plain, raw = split_payload(extra)
        texts.append(plain.select("session_id", "path", "role", "text"))
    if texts:
        done = done.unionByName(redact_files(_all(texts), salt, registry))
    bundle = F.concat(F.lit("bnd_"), F.substring(F.sha2(F.concat(F.lit(salt), "session_id").cast("binary"), 256), 1, 20)).alias("bundle_id")
    done = work.keep(done.select(bundle, "*"))
    totals = work.keep(report.preview(report.inventory(done, "path", "text", "bundle_id"), "bundle_id").join(done.groupBy("bundle_id").agg(F.sum("unresolved").cast("long").alias("left")), "bundle_id"))
    allowed = totals if allow_blocked else totals.where("not export_blocked and left = 0")
    reports = report.report(done, "bundle_id").select("bundle_id", F.lit("redaction-report.json").alias("path"), F.lit("redaction_report").alias("role"), F.col("report").cast("binary").alias("content"))
    payload = done.select("bundle_id", "path", "role", F.col("redacted").cast("binary").alias("content")).unionByName(reports).unionByName(schemas.add(totals, schemas_from))
    if raw is not None:
        payload = payload.unionByName(raw.select(bundle, "path", "role", "content"))
    payload = work.keep(payload.join(allowed.select("bundle_id"), "bundle_id", "left_semi"))
    ids = sessions.select(bundle, "session_id", "agent_version").join(totals, "bundle_id")
    cause = ids.join(told, "session_id", "left") if told is not None else ids.withColumns({c: F.lit(None).cast("string") for c in ("incident_id", "incident_producer")})
    commit, dirty = (F.lit((state or {}).get(k)) for k in ("commit", "dirty"))
    facts = cause.select(
        "bundle_id", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("created_at"),
        F.struct(F.lit(MANIFEST_AGENT.get(agent.lower(), "unknown")).alias("agent"), "agent_version", F.lit("resolved").alias("session_ref_status"), "incident_id", "incident_producer").alias("source"),
        F.struct(F.lit("1.0").alias("policy_version"), (F.col("total_redactions") > 0).alias("applied"), F.col("total_redactions").alias("total_replacements"), F.col("left").alias("unresolved_high_confidence"), F.lit(0).cast("long").alias("hard_deny_overrides")).alias("redaction"),
        manifest.reproduction(commit.cast("string"), dirty.cast("boolean")).alias("reproduction"),
    )
    facts = work.keep(facts)
    guide = manifest.reproduce_md(manifest.build(payload, facts).where("code is null"))
    guide = guide.select("bundle_id", F.lit("REPRODUCE.md").alias("path"), F.lit("reproduce").alias("role"), F.col("text").cast("binary").alias("content"))
    return write(work.keep(payload.unionByName(guide)), facts, folder)


def _all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def write(payload: DataFrame, facts: DataFrame, folder: str, zstd: bool = True) -> DataFrame:
    """payload (bundle_id, path, role, content) with its manifest and checksums, as archives."""
    built = Working(payload.sparkSession, "manifests").keep(manifest.build(payload, facts).where("code is null"))
    members = payload.select("bundle_id", "path", F.col("content").cast("binary").alias("content")).join(built.select("bundle_id"), "bundle_id", "left_semi")
    for path, column in (("manifest.json", "manifest_json"), ("checksums.txt", "checksums")):
        members = members.unionByName(built.select("bundle_id", F.lit(path).alias("path"), F.col(column).cast("binary").alias("content")))
    return archives.write_bundles(members, folder, zstd)


def inspect(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Summaries and file tables of bundles."""
    found = checks.manifests_of(archives.read_members(spark, path)).where("manifest is not null").withColumn("bundle_id", F.col("manifest.bundle_id"))
    return manifest.summary(found), manifest.file_table(found)


def verify(spark: SparkSession, path: str, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """Issues of bundles, and a row per bundle with its exit code."""
    work = Working(spark, "verify")
    members = work.keep(archives.read_members(spark, path))
    issues = work.keep(checks.verify(members, strict))
    return issues, checks.rollup(issues, members.select("bundle").distinct())


def may_prepare(verified: DataFrame, manifests: DataFrame) -> DataFrame:
    """bundle, ready: strictly valid and with a baseline commit; working trees are not a matter for a cluster."""
    commit = manifests.select("bundle", F.col("manifest.reproduction.baseline_commit").alias("commit"))
    ready = F.col("valid") & F.coalesce(F.col("commit"), F.lit("")).rlike("^[0-9a-fA-F]{7,64}$")
    return verified.join(commit, "bundle", "left").select("bundle", F.coalesce(ready, F.lit(False)).alias("ready"))
