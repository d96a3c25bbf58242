"""Manifests, checksums and capabilities of bundles; many bundles in one plan.

A payload is a DataFrame (bundle_id, path, role, content).
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.policy import MAX_FILE_BYTES, MAX_PAYLOAD_BYTES

# Enumerations of the manifest.
ROLES = ("schema", "incident", "session", "session_metadata", "environment", "git_state", "evidence_index", "evidence", "redaction_report", "reproduce")
AGENTS = ("claude-code", "codex-cli", "none", "opencode", "unknown")
CLASSIFICATIONS = ("exact_candidate", "inspection_only", "partial")
REF_STATUSES = ("not_provided", "resolved", "unresolved")
ROLE_LABELS = {
    "session": "Session transcript",
    "session_metadata": "Session metadata",
    "environment": "Environment info",
    "git_state": "Git state",
    "incident": "Incident record",
    "evidence": "Evidence file",
    "evidence_index": "Evidence index",
    "redaction_report": "Redaction report",
    "schema": "JSON Schema",
    "reproduce": "Reproduction instructions",
}
#: Members that are not listed in the manifest.
UNLISTED = ("manifest.json", "checksums.txt")

FILE = "struct<path:string,role:string,media_type:string,bytes:bigint,sha256:string>"
# The fields of the nested objects.
OBJECTS = {
    "generator": "name:string,version:string,build_commit:string",
    "source": "agent:string,agent_version:string,session_ref_status:string,incident_id:string,incident_producer:string",
    "capabilities": "session_excerpt:boolean,environment:boolean,git_state:boolean,evidence:boolean,incident:boolean,prepare_supported:boolean,exact_llm_replay:boolean",
    "redaction": "policy_version:string,applied:boolean,total_replacements:bigint,unresolved_high_confidence:bigint,hard_deny_overrides:bigint",
    "limits": "max_file_bytes:bigint,max_bundle_bytes:bigint,actual_payload_bytes:bigint",
    "reproduction": "classification:string,baseline_commit:string,reasons_not_exact:array<string>",
}
MANIFEST = "struct<manifest_version:string,bundle_id:string,created_at:string," + ",".join(f"{k}:struct<{v}>" for k, v in OBJECTS.items()) + f",files:array<{FILE}>>"


def role_label(role: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in ROLE_LABELS.items() for x in pair]), role), role)


def overlay(base: DataFrame, over: DataFrame, *keys: str) -> DataFrame:
    """Both payloads; where a path is in both, the row of `over`."""
    both = base.withColumn("_p", F.lit(0)).unionByName(over.withColumn("_p", F.lit(1)))
    first = W.partitionBy(*keys, "path").orderBy(F.col("_p").desc())
    return both.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_p", "_n")


def entries(payload: DataFrame) -> DataFrame:
    """payload with bytes and sha256."""
    return payload.withColumns({"bytes": F.octet_length("content").cast("long"), "sha256": F.sha2(F.col("content").cast("binary"), 256)})


def checksums(files: DataFrame, *keys: str) -> DataFrame:
    """Per bundle: digest and path lines, by path, with a last newline."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct("path", "sha256"))), lambda x: F.concat(x["sha256"], F.lit("  "), x["path"]))
    return files.groupBy(*keys).agg(F.concat(F.array_join(listed, "\n"), F.lit("\n")).alias("checksums"))


def capabilities(files: DataFrame, *keys: str) -> DataFrame:
    has = lambda name: F.coalesce(F.bool_or(F.col("path") == name), F.lit(False))
    return files.groupBy(*keys).agg(
        has("session.jsonl").alias("session_excerpt"), has("environment.json").alias("environment"), has("git-state.json").alias("git_state"),
        F.coalesce(F.bool_or(F.col("path").startswith("evidence/")), F.lit(False)).alias("evidence"), has("incident.json").alias("incident"),
        has("git-state.json").alias("prepare_supported"), F.lit(False).alias("exact_llm_replay"),
    )


def reproduction(commit: Column, dirty: Column) -> Column:
    """Classification, commit and reasons; a state that doesn't say whether it is clean counts as changed."""
    none = F.lit("llm_output_nondeterministic")
    reasons = F.when(commit.isNull(), F.array(F.lit("no_git_baseline"), none)).when(F.coalesce(dirty, F.lit(True)), F.array(F.lit("uncommitted_changes"), none)).otherwise(F.array(none))
    return F.struct(F.when(commit.isNull(), "inspection_only").otherwise("partial").alias("classification"), commit.alias("baseline_commit"), reasons.alias("reasons_not_exact"))


def build(payload: DataFrame, facts: DataFrame, version: str = "0.1.0") -> DataFrame:
    """Per bundle: bundle_id, manifest (struct), manifest_json, checksums, total_bytes, code.

    facts: bundle_id, source, redaction, reproduction (structs of the manifest), created_at; null
    structs get their defaults.  code is E_BUNDLE_SIZE where the payload exceeds the limit.
    """
    files = entries(payload)
    listed = files.groupBy("bundle_id").agg(
        F.array_sort(F.collect_list(F.struct("path", "role", F.lit(None).cast("string").alias("media_type"), "bytes", "sha256"))).alias("files"), F.sum("bytes").alias("bytes")
    )
    caps = capabilities(files, "bundle_id")
    joined = listed.join(checksums(files, "bundle_id"), "bundle_id").join(caps, "bundle_id").join(facts, "bundle_id", "left")
    default = lambda name, kind: F.coalesce(F.col(name), F.from_json(F.lit("{}"), kind))
    source, redaction = (default(n, f"struct<{OBJECTS[n]}>") for n in ("source", "redaction"))
    limits = F.struct(F.lit(MAX_FILE_BYTES).cast("long").alias("max_file_bytes"), F.lit(MAX_PAYLOAD_BYTES).cast("long").alias("max_bundle_bytes"), (F.col("bytes") + F.octet_length("checksums")).cast("long").alias("actual_payload_bytes"))
    body = F.struct(
        F.lit("1.0").alias("manifest_version"), "bundle_id", F.struct(F.lit("logbrook").alias("name"), F.lit(version).alias("version"), F.lit(None).cast("string").alias("build_commit")).alias("generator"),
        F.coalesce("created_at", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("created_at"),
        F.struct(F.coalesce(source["agent"], F.lit("unknown")).alias("agent"), source["agent_version"].alias("agent_version"), F.coalesce(source["session_ref_status"], F.lit("not_provided")).alias("session_ref_status"), source["incident_id"].alias("incident_id"), source["incident_producer"].alias("incident_producer")).alias("source"),
        F.struct(*[F.col(c) for c in caps.columns if c != "bundle_id"]).alias("capabilities"),
        F.struct(F.coalesce(redaction["policy_version"], F.lit("1.0")).alias("policy_version"), F.coalesce(redaction["applied"], F.lit(False)).alias("applied"), *[F.coalesce(redaction[c], F.lit(0).cast("long")).alias(c) for c in ("total_replacements", "unresolved_high_confidence", "hard_deny_overrides")]).alias("redaction"),
        limits.alias("limits"), F.coalesce("reproduction", reproduction(F.lit(None).cast("string"), F.lit(None).cast("boolean"))).alias("reproduction"), "files",
    )
    out = joined.select("bundle_id", body.alias("manifest"), "checksums").withColumn("manifest_json", to_json(F.col("manifest")))
    total = F.col("manifest.limits.actual_payload_bytes") + F.octet_length("manifest_json")
    return out.withColumns({"total_bytes": total.cast("long"), "code": F.when(total > MAX_PAYLOAD_BYTES, "E_BUNDLE_SIZE")})


def to_json(manifest: Column) -> Column:
    """Nulls are written, but for a file's missing media type."""
    files = F.to_json(F.transform(manifest["files"], lambda f: f))
    head = F.struct(*[manifest[c].alias(c) for c in ("manifest_version", "bundle_id", "generator", "created_at", "source", "capabilities", "redaction", "limits", "reproduction")])
    rest = F.to_json(head, {"ignoreNullFields": "false"})
    return F.concat(F.lit('{"$schema":"./schemas/bundle-manifest-1.json",'), F.substr(rest, F.lit(2), F.length(rest) - 2), F.lit(',"files":'), files, F.lit("}"))


def from_json(text: Column) -> Column:
    return F.from_json(text, MANIFEST)


def new_bundle_id() -> str:
    return "bnd_" + uuid.uuid4().hex[:20]


def problems(m: Column) -> Column:
    """Messages of the structural checks, in order."""
    empty = lambda c: c.isNull() | (c == "")
    one_of = lambda c, names: F.coalesce(c.isin(*names), F.lit(False))
    said = lambda what, names, c: F.concat(F.lit(f"{what} must be one of {sorted(names)}, got '"), F.coalesce(c, F.lit("")), F.lit("'"))
    files = F.coalesce(m["files"], F.array().cast(f"array<{FILE}>"))
    per_file = F.flatten(F.transform(files, lambda f: F.array(
        F.when(~one_of(f["role"], ROLES), F.concat(F.lit("file '"), f["path"], F.lit("' has invalid role '"), F.coalesce(f["role"], F.lit("")), F.lit("'"))),
        F.when(F.coalesce(F.length(f["sha256"]), F.lit(0)) != 64, F.concat(F.lit("file '"), f["path"], F.lit("' sha256 must be 64 hex chars"))),
    )))
    paths = F.transform(files, lambda f: f["path"])
    before = F.array(
        F.when(empty(m["manifest_version"]), "manifest_version is required"),
        F.when(empty(m["bundle_id"]), "bundle_id is required").when(~m["bundle_id"].startswith("bnd_"), "bundle_id must start with 'bnd_'"),
        F.when(empty(m["generator"]["name"]), "generator.name is required"), F.when(empty(m["generator"]["version"]), "generator.version is required"),
        F.when(empty(m["created_at"]), "created_at is required"),
        F.when(empty(m["source"]["agent"]), "source.agent is required").when(~one_of(m["source"]["agent"], AGENTS), said("source.agent", AGENTS, m["source"]["agent"])),
        F.when(~one_of(m["source"]["session_ref_status"], REF_STATUSES), said("source.session_ref_status", REF_STATUSES, m["source"]["session_ref_status"])),
    )
    after = F.array(
        F.when(~one_of(m["reproduction"]["classification"], CLASSIFICATIONS), said("reproduction.classification", CLASSIFICATIONS, m["reproduction"]["classification"])),
        F.when(F.array_sort(paths) != paths, "files must be sorted by path"),
        F.when(F.size(F.array_distinct(paths)) != F.size(paths), "files paths must be unique"),
    )
    return F.array_compact(F.concat(before, per_file, after))


def summary(manifests: DataFrame) -> DataFrame:
    """One row per bundle, for inspection."""
    m = F.col("manifest")
    return manifests.select(
        "bundle_id", m["manifest_version"].alias("manifest_version"), F.concat(m["generator"]["name"], F.lit(" v"), m["generator"]["version"]).alias("generator"), m["source"]["agent"].alias("source_agent"),
        m["source"]["session_ref_status"].alias("session_ref_status"), m["created_at"].alias("created_at"), F.size(m["files"]).cast("long").alias("file_count"),
        m["capabilities"].alias("capabilities"), m["redaction"].alias("redaction"), m["limits"].alias("limits"), m["reproduction"].alias("reproduction"),
    )


def file_table(manifests: DataFrame) -> DataFrame:
    rows = manifests.select("bundle_id", F.explode("manifest.files").alias("f"))
    return rows.select("bundle_id", "f.path", "f.role", "f.bytes", F.concat(F.substring("f.sha256", 1, 16), F.lit("...")).alias("sha256"))


def reproduce_md(manifests: DataFrame) -> DataFrame:
    """bundle_id, text: a document for people, made of what the manifest says and nothing else."""
    m = F.col("manifest")
    line = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    listed = F.array_join(F.transform(m["files"], lambda f: F.concat(F.lit("- "), f["path"], F.lit(" ("), role_label(f["role"]), F.lit(")"))), "\n")
    cause = F.when(m["source"]["incident_id"].isNotNull(), line("Captured for incident `", m["source"]["incident_id"], "`.")).otherwise("Captured from a session.")
    base = F.when(m["reproduction"]["baseline_commit"].isNotNull(), line("- Commit `", m["reproduction"]["baseline_commit"], "`")).otherwise("- No commit was recorded.")
    reasons = F.array_join(F.transform(m["reproduction"]["reasons_not_exact"], lambda r: F.concat(F.lit("- "), r)), "\n")
    text = F.concat_ws(
        "\n", line("# Reproduction Bundle: ", m["bundle_id"]), F.lit(""), line("Generated: ", m["created_at"]), line("Agent: ", m["source"]["agent"], " ", F.coalesce(m["source"]["agent_version"], F.lit(""))), F.lit(""), cause,
        F.lit("\nChecksums show integrity, not authorship. Model output is not replayed, and nothing here is run automatically.\n"), F.lit("## Baseline\n"), base, F.lit("\n## Contents\n"), listed,
        line("\n## Redaction\n\n- Replacements: ", m["redaction"]["total_replacements"].cast("string"), "\n- Unresolved: ", m["redaction"]["unresolved_high_confidence"].cast("string")),
        line("\n## Reproduction\n\n**", m["reproduction"]["classification"], "**"), reasons, F.lit(""),
    )
    return manifests.select("bundle_id", text.alias("text"))
