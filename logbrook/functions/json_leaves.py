"""Redaction of the string leaves of JSON texts, at any depth: keys, numbers and structure stay as they are.

A text is cut at its string literals.  Those that a colon follows are keys; the others are unescaped,
redacted as texts of their own, escaped again and put back between the pieces that were around them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .patterns import Registry
from .redact import CHANGE, redact, unresolved_high

LITERAL = r'(?s)"[^"\\]*+(?:\\.[^"\\]*+)*+"'


def unescaped(literal: Column) -> Column:
    return F.get(F.from_json(F.concat(F.lit("["), literal, F.lit("]")), "array<string>"), 0)


def escaped(text: Column) -> Column:
    listed = F.to_json(F.array(text))
    return F.substr(listed, F.lit(2), F.length(listed) - 2)


def redact_json(rows: DataFrame, column: str, keys: list[str], salt: str | None = "", registry: Registry | None = None, line: Column | None = None) -> DataFrame:
    """rows (keys, …, column) with `redacted`, `changes` and `unresolved`; keys name a row.

    A change's line is `line` (1 if not given); its column is its place in the leaf.
    """
    cut = rows.select(*keys, (F.lit(1) if line is None else line).cast("long").alias("_line"), F.regexp_extract_all(column, F.lit(LITERAL), 0).alias("_m"), F.split(column, LITERAL, -1).alias("_g"))
    leaves = cut.select(*keys, "_line", F.get("_g", 0).alias("_head"), F.posexplode(F.arrays_zip(F.col("_m").alias("m"), F.slice("_g", 2, F.greatest(F.size("_g") - 1, F.lit(0))).alias("g"))).alias("_pos", "_x"))
    key = F.col("_x.g").rlike(r"^\s*:")
    leaves = leaves.select(*keys, "_line", "_head", "_pos", F.col("_x.m").alias("_own"), F.col("_x.g").alias("_after"), F.when(~key, unescaped(F.col("_x.m"))).alias("_text"))
    done = redact(leaves, "_text", "_r", registry, salt, changes="_c").withColumn("_left", unresolved_high(F.col("_r"), registry))
    own = F.when(F.col("_text").isNull() | (F.size("_c") == 0), F.col("_own")).otherwise(escaped(F.col("_r")))
    piece = F.struct("_pos", F.concat(own, "_after").alias("text"), F.transform("_c", lambda c: c.withField("line", F.col("_line"))).alias("changes"))
    joined = done.groupBy(*keys).agg(F.first("_head").alias("_head"), F.array_sort(F.collect_list(piece)).alias("_p"), F.sum("_left").alias("_left"))
    joined = joined.select(*keys, F.concat("_head", F.array_join(F.transform("_p", lambda p: p["text"]), "")).alias("_r"), F.flatten(F.transform("_p", lambda p: p["changes"])).alias("_c"), "_left")
    out = rows.join(joined, keys, "left")
    none = F.array().cast(f"array<{CHANGE}>")
    return out.select(*rows.columns, F.coalesce("_r", column).alias("redacted"), F.coalesce("_c", none).alias("changes"), F.coalesce("_left", F.lit(0)).cast("long").alias("unresolved"))
