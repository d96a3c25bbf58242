"""Verification of bundles as joins and anti-joins over their members; many bundles at once.

members: bundle, place, name, size, type, mode, content, problem.  Issues: bundle, code, severity,
message.  A bundle whose headers are unsafe is judged by its headers alone; one without a readable
manifest by its members.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.policy import ARCHIVE_DENY, MAX_MEMBERS, MAX_NAME_BYTES
from ..functions.redact import residual
from ..functions.text import suffix
from . import incidents, manifest

# Members that a bundle should hold, and endings that are scanned as text.
REQUIRED = ("manifest.json", "checksums.txt", "REPRODUCE.md", "schemas/bundle-manifest-1.json", "schemas/agent-incident-1.json")
TEXTUAL = (".json", ".jsonl", ".md", ".txt", ".log", ".yaml", ".yml", ".toml")
#: Codes that make exit code 8; codes that begin with ARCHIVE_ make 7.
INTEGRITY = "^(CHECKSUM_|INTEGRITY_|REQUIRED_MISSING|HARD_DENY|RESIDUAL_SECRET|MANIFEST_)"
REPORTS = ("redaction-report.json", "redaction_report.json")


def issue(rows: DataFrame, code: str, message: Column, severity: str = "error") -> DataFrame:
    return rows.select("bundle", F.lit(code).alias("code"), F.lit(severity).alias("severity"), message.alias("message"))


def _named(text: str, column: str = "name") -> Column:
    return F.concat(F.lit(text), F.col(column))


def header_codes(members: DataFrame) -> DataFrame:
    """members with `codes`: what is wrong with each header; the first four end a member's checks."""
    parts = F.split(F.replace(F.col("name"), F.lit("\\"), F.lit("/")), "/")
    first = (
        F.when(F.col("type") != "0", "ARCHIVE_NON_REGULAR")
        .when(F.col("name").isNull() | (F.col("name") == ""), "ARCHIVE_EMPTY_PATH")
        .when(F.array_contains(parts, ".."), "ARCHIVE_TRAVERSAL")
        .when(F.col("name").startswith("/"), "ARCHIVE_ABSOLUTE_PATH")
    )
    stops = members.withColumn("_stop", first)
    place = F.row_number().over(W.partitionBy("bundle", "name", F.col("_stop").isNull()).orderBy("place"))
    rest = F.array(
        F.when(F.col("_place") > 1, "ARCHIVE_DUPLICATE"), F.when(F.octet_length("name") > MAX_NAME_BYTES, "ARCHIVE_LONG_NAME"), F.when(F.col("mode").bitwiseAND(0o7000) != 0, "ARCHIVE_UNSAFE_MODE")
    )
    found = F.when(F.col("_stop").isNotNull(), F.array("_stop")).otherwise(F.array_compact(rest))
    return stops.withColumn("_place", place).withColumn("codes", found).drop("_stop", "_place")


def header_issues(members: DataFrame) -> DataFrame:
    broken = issue(members.where("problem is not null"), "ARCHIVE_READ", F.col("problem"))
    whole = members.where("problem is null")
    many = whole.groupBy("bundle").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > MAX_MEMBERS)
    counted = issue(many, "ARCHIVE_TOO_MANY_MEMBERS", F.format_string(f"%d members, limit {MAX_MEMBERS}", "n"))
    each = header_codes(whole).select("bundle", "name", F.explode("codes").alias("code"))
    return broken.unionByName(counted).unionByName(each.select("bundle", "code", F.lit("error").alias("severity"), F.concat("code", F.lit(": "), F.coalesce("name", F.lit(""))).alias("message")))


def required_issues(members: DataFrame, strict: bool = False) -> DataFrame:
    wanted = members.select("bundle").distinct().select("bundle", F.explode(F.array(*[F.lit(x) for x in REQUIRED])).alias("name"))
    gone = wanted.join(members.select("bundle", "name"), ["bundle", "name"], "left_anti")
    always = F.col("name").isin("manifest.json", "checksums.txt")
    return gone.select("bundle", F.lit("REQUIRED_MISSING").alias("code"), F.when(always | F.lit(strict), "error").otherwise("warning").alias("severity"), _named("Required member missing: ").alias("message"))


def checksum_lines(members: DataFrame) -> DataFrame:
    """bundle, line, digest, path; digest is null where the line has no two spaces."""
    text = F.col("content").cast("string")
    rows = members.where("name = 'checksums.txt'").select("bundle", F.posexplode(F.split(text, "\n")).alias("n", "line")).withColumn("line", F.trim("line")).where("line <> ''")
    cut = F.instr("line", "  ")
    return rows.select("bundle", "n", "line", F.when(cut > 0, F.trim(F.substr("line", F.lit(1), cut - 1))).alias("digest"), F.when(cut > 0, F.substr("line", cut + 2)).alias("path"))


def inventory_issues(files: DataFrame, members: DataFrame, strict: bool = False) -> DataFrame:
    """files: bundle, path of the manifest."""
    soft = "error" if strict else "warning"
    there = members.select("bundle", F.col("name").alias("path"))
    gone = issue(files.select("bundle", "path").join(there, ["bundle", "path"], "left_anti"), "FILE_MISSING", _named("In manifest but not in archive: ", "path"))
    extra = there.where(~F.col("path").isin(*manifest.UNLISTED)).join(files.select("bundle", "path"), ["bundle", "path"], "left_anti")
    return gone.unionByName(issue(extra, "FILE_UNKNOWN", _named("In archive but not in manifest: ", "path"), soft))


def checksum_issues(files: DataFrame, members: DataFrame, sums: DataFrame, strict: bool = False) -> DataFrame:
    """files: bundle, path, sha256; members: bundle, name, sha256 of the content; sums: bundle, path, digest."""
    soft = "error" if strict else "warning"
    there = members.select("bundle", F.col("name").alias("path"), F.col("sha256").alias("actual"))
    last = sums.groupBy("bundle", "path").agg(F.max_by("digest", "n").alias("digest")) if "n" in sums.columns else sums
    joined = files.select("bundle", "path", "sha256").join(there, ["bundle", "path"], "left").join(last, ["bundle", "path"], "left")
    codes = F.array_compact(F.array(
        F.when(F.col("actual").isNull(), "CHECKSUM_READ").when(F.col("actual") != F.col("sha256"), "CHECKSUM_CONTENT"),
        F.when(F.col("digest").isNull(), "CHECKSUM_MISSING_ENTRY").when(F.col("digest") != F.col("sha256"), "CHECKSUM_MISMATCH"),
    ))
    each = joined.select("bundle", "path", F.explode(codes).alias("code")).select("bundle", "code", F.lit("error").alias("severity"), F.concat("code", F.lit(": "), "path").alias("message"))
    extra = last.join(files.select("bundle", "path"), ["bundle", "path"], "left_anti")
    return each.unionByName(issue(extra, "CHECKSUM_EXTRA", _named("checksums.txt has entry not in manifest: ", "path"), soft))


def report_issues(members: DataFrame, files: DataFrame) -> DataFrame:
    rows = members.where(F.col("name").isin(*REPORTS)).withColumn("v", F.try_parse_json(F.col("content").cast("string")))
    n = F.try_variant_get("v", "$.high_confidence_unresolved", "bigint")
    bad = F.col("v").isNull() | ~F.coalesce(F.schema_of_variant("v").startswith("OBJECT"), F.lit(False))
    code = F.when(bad, "REDACTION_PARSE").when(n == 0, "REDACTION_REPORT").when(n > 0, "REDACTION_UNRESOLVED").otherwise("REDACTION_REPORT_MISSING_FIELD")
    severity = F.when(n == 0, "info").when(bad | (n > 0), "error").otherwise("warning")
    found = rows.select("bundle", code.alias("code"), severity.alias("severity"), F.concat("name", F.lit(": unresolved = "), F.coalesce(n.cast("string"), F.lit("not given"))).alias("message"))
    gone = files.where("path = 'redaction-report.json'").join(rows.select("bundle"), "bundle", "left_anti")
    return found.unionByName(issue(gone, "REDACTION_MISSING", F.lit("redaction-report.json is in the manifest but can't be read")))


def deny_issues(members: DataFrame) -> DataFrame:
    reason = F.coalesce(*[F.when(F.col("name").rlike(regex), F.lit(why)) for why, regex in ARCHIVE_DENY])
    found = members.select("bundle", "name", reason.alias("reason")).where("reason is not null").distinct()
    return issue(found, "HARD_DENY_PATH", F.concat(F.lit("Hard-deny path in archive: "), "name", F.lit(" ("), "reason", F.lit(")")))


def residual_issues(members: DataFrame) -> DataFrame:
    text = F.make_valid_utf8(F.col("content").cast("string"))
    found = members.where(F.lower(suffix(F.col("name"))).isin(*TEXTUAL)).select("bundle", "name", residual(text).alias("hit")).where("hit is not null")
    return issue(found, "RESIDUAL_SECRET", F.concat(F.lit("Possible residual secret in "), "name", F.lit(": "), F.substring("hit", 1, 80)), "warning")


def incident_issues(members: DataFrame) -> DataFrame:
    schema = members.where("name = 'schemas/agent-incident-1.json'").select("bundle")
    rows = members.where("name = 'incident.json'").join(schema, "bundle", "left_semi").withColumn("v", F.try_parse_json(F.col("content").cast("string")))
    good = rows.where("v is not null").withColumn("found", incidents.problems(F.col("v")))
    bad = issue(rows.where("v is null"), "INCIDENT_PARSE", F.lit("incident.json is not JSON"))
    valid = issue(good.where(F.size("found") == 0), "INCIDENT_VALID", F.lit("incident.json validates against schema"), "info")
    wrong = good.select("bundle", F.explode(F.slice("found", 1, 5)).alias("m"))
    return bad.unionByName(valid).unionByName(issue(wrong, "INCIDENT_SCHEMA", F.concat(F.lit("incident.json: "), "m")))


def schema_problems(v: Column, m: Column) -> Column:
    """What the manifest schema forbids in the raw JSON: types, the version's form, unknown keys inside."""
    kind = lambda p: F.coalesce(F.schema_of_variant(F.try_variant_get(v, p, "variant")), F.lit("VOID"))
    found = [F.when(~F.coalesce(m["manifest_version"].rlike(r"^1\.[0-9]+$"), F.lit(False)), "manifest_version does not match 1.N")]
    for name, fields in manifest.OBJECTS.items():
        found.append(F.when(~kind(f"$.{name}").startswith("OBJECT"), F.lit(f"'{name}' is not an object")))
        keys = F.map_keys(F.try_variant_get(v, f"$.{name}", "map<string,variant>"))
        found.append(F.when(F.size(F.array_except(keys, F.array(*[F.lit(f.split(":")[0]) for f in fields.split(",")]))) > 0, F.lit(f"'{name}' has unknown keys")))
    found.append(F.when(~kind("$.files").startswith("ARRAY"), "'files' is not an array"))
    found.append(F.when(F.exists(F.coalesce(m["files"], F.array().cast(f"array<{manifest.FILE}>")), lambda f: ~F.coalesce(f["sha256"].rlike("^[0-9a-f]{64}$"), F.lit(False))), "a file's sha256 is not 64 lower-case hex digits"))
    return F.array_compact(F.array(*found))


def manifests_of(members: DataFrame) -> DataFrame:
    """bundle, v, manifest of the members named manifest.json; null where it is no JSON object."""
    text = F.col("content").cast("string")
    v = F.try_parse_json(text)
    ok = F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))
    return members.where("name = 'manifest.json'").select("bundle", F.when(ok, v).alias("v"), F.when(ok, manifest.from_json(text)).alias("manifest"))


def verify(members: DataFrame, strict: bool = False) -> DataFrame:
    """Every issue of every bundle.  `members` is read several times; write or cache it first."""
    from .. import schemas

    headers = header_issues(members)
    safe = members.where("problem is null").join(headers.select("bundle").distinct(), "bundle", "left_anti")
    named = safe.withColumn("sha256", F.sha2("content", 256))
    out = [headers, required_issues(safe, strict)]
    found = manifests_of(safe)
    out.append(issue(found.where("manifest is null"), "MANIFEST_PARSE", F.lit("manifest.json is not a JSON object")))
    good = found.where("manifest is not null")
    rest = named.join(good.select("bundle"), "bundle", "left_semi")
    files = good.select("bundle", F.explode("manifest.files").alias("f")).select("bundle", "f.path", "f.sha256")
    out.append(issue(good, "MANIFEST_EXISTS", F.lit("manifest.json found and parsed"), "info"))
    out.append(issue(good.select("bundle", F.explode(manifest.problems(F.col("manifest"))).alias("m")), "MANIFEST_STRUCT", F.concat(F.lit("manifest.json: "), "m")))
    schema = rest.where("name = 'schemas/bundle-manifest-1.json'").select("bundle")
    checked = good.join(schema, "bundle", "left_semi").withColumn("found", schema_problems(F.col("v"), F.col("manifest")))
    out.append(issue(checked.where(F.size("found") == 0), "MANIFEST_SCHEMA", F.lit("manifest.json validates against schema"), "info"))
    out.append(issue(checked.select("bundle", F.explode(F.slice("found", 1, 5)).alias("m")), "MANIFEST_SCHEMA", F.concat(F.lit("manifest.json schema: "), "m")))
    held = schemas.against_files(rest).groupBy("bundle", "name").agg(F.slice(F.array_sort(F.collect_set("message")), 1, 5).alias("found"))
    by_file = F.when(F.col("name") == "manifest.json", "MANIFEST_SCHEMA_FILE").otherwise("INCIDENT_SCHEMA_FILE")
    out.append(issue(held.select("bundle", by_file.alias("code"), "name", F.explode("found").alias("m")), "", F.concat("name", F.lit(": "), "m")).drop("code").withColumn("code", F.lit("MANIFEST_SCHEMA")))
    sums = checksum_lines(rest)
    out.append(issue(sums.where("digest is null"), "CHECKSUMS_FORMAT", F.concat(F.lit("Invalid checksums.txt line: "), "line")))
    without = good.select("bundle").join(rest.where("name = 'checksums.txt'").select("bundle"), "bundle", "left_anti")
    out.append(issue(without, "CHECKSUMS_MISSING", F.lit("Cannot read checksums.txt")))
    out.append(inventory_issues(files, rest, strict))
    out.append(checksum_issues(files, rest, sums.where("digest is not null"), strict))
    out += [incident_issues(rest), report_issues(rest, files), deny_issues(rest), residual_issues(rest)]
    out.append(issue(good, "OFFLINE", F.lit("Verification performed entirely offline"), "info"))
    return reduce(DataFrame.unionByName, out)


def rollup(issues: DataFrame, bundles: DataFrame | None = None) -> DataFrame:
    """Per bundle: valid, errors, warnings (all that are no errors), summary, exit_code."""
    sums = issues.groupBy("bundle").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("severity") == "error").cast("long").alias("errors"),
        F.coalesce(F.bool_or((F.col("severity") == "error") & F.col("code").startswith("ARCHIVE_")), F.lit(False)).alias("archive"),
        F.coalesce(F.bool_or((F.col("severity") == "error") & F.col("code").rlike(INTEGRITY)), F.lit(False)).alias("integrity"),
    )
    if bundles is not None:
        sums = bundles.join(sums, "bundle", "left").fillna(0, ["total", "errors"]).fillna(False, ["archive", "integrity"])
    valid = F.col("errors") == 0
    warnings = F.col("total") - F.col("errors")
    text = F.when(valid, F.format_string("VALID — %d checks passed", "total")).otherwise(F.format_string("INVALID — %d errors, %d warnings", F.col("errors"), warnings))
    code = F.when(valid, 0).when(F.col("archive"), 7).when(F.col("integrity"), 8).otherwise(1).cast("long")
    return sums.select("bundle", valid.alias("valid"), "errors", warnings.alias("warnings"), text.alias("summary"), code.alias("exit_code"))
