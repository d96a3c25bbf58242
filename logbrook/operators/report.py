"""Redaction reports and previews over the `changes` that redact() leaves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.patterns import Registry
from ..functions.redact import snippet
from ..functions.text import human_size

VERSION = "1.0"


def changes(redacted: DataFrame, file: str = "path", *carry: str, text: str = "redacted") -> DataFrame:
    """One row per replacement, with its file and a snippet of the redacted text."""
    rows = redacted.select(*carry, F.col(file).alias("file"), F.col(text).alias("_t"), F.explode("changes").alias("_c"))
    return rows.select(*carry, "file", "_c.*", snippet(F.col("_t"), F.col("_c.placeholder")).alias("snippet"))


def by(found: DataFrame, column: str, *keys: str) -> DataFrame:
    return found.groupBy(*keys, column).agg(F.count(F.lit(1)).alias("n"))


def rollup(found: DataFrame) -> DataFrame:
    """Counts by category and pattern, with subtotals and the total."""
    return found.rollup("category", "pattern").agg(F.count(F.lit(1)).alias("n"))


def high_count(found: Column) -> Column:
    return F.size(F.filter(found, lambda x: x["high"])).cast("long")


def placeholders(found: DataFrame, *keys: str) -> DataFrame:
    """Per placeholder: category and pattern where it was seen first, and all its locations in order.

    keys name a bundle, whose payload limit bounds the locations; beyond one bundle see placeholder_counts.
    """
    order = F.struct("file", "line", "column", "pass")
    return found.groupBy(*keys, "placeholder").agg(
        F.min_by("category", order).alias("category"), F.min_by("pattern", order).alias("pattern_name"),
        F.array_sort(F.collect_list(F.struct("file", "line", "column", "snippet"))).alias("locations"),
    )


def placeholder_counts(found: DataFrame, *keys: str) -> DataFrame:
    """Per placeholder: category, locations and files, combined map-side; for more than one bundle's worth of changes."""
    order = F.struct("file", "line", "column", "pass")
    return found.groupBy(*keys, "placeholder").agg(F.min_by("category", order).alias("category"), F.count(F.lit(1)).alias("n_locations"), F.count_distinct("file").alias("n_files"))


def report(redacted: DataFrame, *keys: str, file: str = "path") -> DataFrame:
    """One JSON report per bundle (keys): totals, counts and placeholders; unresolved counts what a second scan finds."""
    found = changes(redacted, file, *keys)
    total = redacted.groupBy(*keys).agg(F.sum(F.size("changes")).cast("long").alias("total_redactions"), F.sum("unresolved").cast("long").alias("high_confidence_unresolved"))
    on = list(keys)
    counts = [by(found, c, *keys).groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(c, "n")))).alias(f"by_{c}")) for c in ("category", "pattern")]
    listed = placeholders(found, *keys).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col("placeholder").alias("id"), "category", "pattern_name", "locations"))).alias("placeholders"))
    out = total
    for part in (*counts, listed):
        out = out.join(part, on, "left") if on else out.crossJoin(F.broadcast(part))  # without keys each side is one row
    empty = {"by_category": "map<string,bigint>", "by_pattern": "map<string,bigint>"}
    body = F.struct(
        F.lit(VERSION).alias("redaction_version"), F.lit("logbrook").alias("generator"), F.lit("0.1.0").alias("generator_version"), "total_redactions",
        *[F.coalesce(F.col(c), F.from_json(F.lit("{}"), t)).alias(c) for c, t in empty.items()],
        F.coalesce("placeholders", F.array().cast("array<struct<id:string,category:string,pattern_name:string,locations:array<struct<file:string,line:bigint,column:bigint,snippet:string>>>>")).alias("placeholders"),
        "high_confidence_unresolved",
    )
    return out.select(*keys, F.to_json(body, {"ignoreNullFields": "false"}).alias("report"))


def inventory(redacted: DataFrame, file: str = "path", text: str = "text", *carry: str) -> DataFrame:
    """Per file: sizes in bytes before and after, redactions, those of high confidence."""
    return redacted.select(
        *carry, F.col(file).alias("path"), F.octet_length(F.coalesce(F.col(text), F.lit(""))).cast("long").alias("original_size"),
        F.octet_length("redacted").cast("long").alias("redacted_size"), F.size("changes").cast("long").alias("redactions"), high_count(F.col("changes")).alias("high_confidence"),
    )


def risk(high: Column, medium: Column) -> Column:
    return F.when(high > 0, "blocked").when(medium > 0, "medium").otherwise("low")


def preview(files: DataFrame, *keys: str) -> DataFrame:
    """Totals over an inventory; medium is what is not high, so custom patterns count as medium."""
    sums = files.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_files"), *[F.sum(c).cast("long").alias(a) for c, a in (("original_size", "total_original_size"), ("redacted_size", "total_redacted_size"), ("redactions", "total_redactions"), ("high_confidence", "high_confidence_count"))],
    )
    medium = F.col("total_redactions") - F.col("high_confidence_count")
    level = risk(F.col("high_confidence_count"), medium)
    return sums.withColumns({"medium_confidence_count": medium, "risk_level": level, "export_blocked": level.isin("blocked", "high")})


def warnings(redacted: DataFrame, file: str = "path", registry: Registry | None = None, by_pass: bool = False) -> DataFrame:
    """One warning per file that has a medium match: its first in the text, or with by_pass that of the pattern applied first."""
    names = (registry or Registry()).names("medium")
    medium = F.filter("changes", lambda x: x["pattern"].isin(names))
    first = F.array_min(F.transform(medium, lambda x: F.struct(x["pass"].alias("pass"), x["pattern"].alias("pattern")))) if by_pass else F.get(medium, F.lit(0))
    message = F.concat(F.lit("Medium-confidence pattern '"), first["pattern"], F.lit("' matched — verify manually"))
    return redacted.select(F.col(file).alias("path"), first["pattern"].alias("pattern"), message.alias("warning")).where("pattern is not null")


def preview_text(redacted: DataFrame, *keys: str, file: str = "path", registry: Registry | None = None) -> DataFrame:
    """keys, text: a preview for people, a document per bundle; categories and files in alphabetical order."""
    listed = inventory(redacted, file, "text", *keys)
    totals = preview(listed, *keys)
    size = F.concat(human_size(F.col("original_size")), F.lit(" -> "), human_size(F.col("redacted_size")))
    line = F.concat(F.lit("* "), "path", F.lit(": "), size, F.lit(", "), F.col("redactions").cast("string"), F.lit(" replaced, "), F.col("high_confidence").cast("string"), F.lit(" of high confidence"))
    files = listed.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("path", line.alias("line")))).alias("files"))
    kinds = by(changes(redacted, file, *keys), "category", *keys)
    kinds = kinds.groupBy(*keys).agg(F.array_sort(F.collect_list(F.concat(F.lit("* "), "category", F.lit(": "), F.col("n").cast("string")))).alias("kinds"))
    names = (registry or Registry()).names("medium")
    first = F.get(F.filter("changes", lambda x: x["pattern"].isin(names)), F.lit(0))["pattern"]
    told = redacted.select(*keys, F.concat(F.lit("* "), F.col(file), F.lit(": "), first).alias("w")).where("w is not null").groupBy(*keys).agg(F.array_sort(F.collect_list("w")).alias("told"))
    on = list(keys)
    joined = totals.join(files, on).join(kinds, on, "left").join(told, on, "left")
    block = lambda title, c: F.when(F.size(c) > 0, F.concat(F.lit(f"{title}\n"), F.array_join(c, "\n")))
    head = F.concat(F.col("total_files").cast("string"), F.lit(" files, "), human_size(F.col("total_original_size")), F.lit(" before and "), human_size(F.col("total_redacted_size")), F.lit(" after"))
    counts = F.concat(F.col("total_redactions").cast("string"), F.lit(" replacements: "), F.col("high_confidence_count").cast("string"), F.lit(" of high, "), F.col("medium_confidence_count").cast("string"), F.lit(" of medium confidence"))
    end = F.when(F.col("export_blocked"), "Blocked: secrets of high confidence were found.").otherwise("Free to export.")
    return joined.select(*keys, F.concat_ws("\n\n", head, counts, F.concat(F.lit("Risk: "), "risk_level", F.lit(". "), end), block("By category", F.col("kinds")), block("Look at these by hand", F.col("told")), block("Files", F.transform("files", lambda f: f["line"]))).alias("text"))
