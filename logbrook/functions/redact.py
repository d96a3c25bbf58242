"""Redaction as a fold of column expressions: every pass sees the text that the one before left.

All of it is native.  A pass splits the text at its matches and joins the gaps with placeholders; a
pass whose anchors are absent costs a substring search.  Placeholders are keyed hashes of the
matched literal, so the same literal gets the same placeholder in every file and on every executor
without a dictionary, and a new salt per capture ends the stability.

Places are found by one running sum over gaps and matches, so a text with many matches is walked once.
Where nothing but the masked text is asked for, a pass is one replacement.
"""

from __future__ import annotations

import secrets
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .patterns import RESIDUAL, Pattern, Registry

CHANGE = "struct<category:string,pattern:string,high:boolean,pass:int,placeholder:string,start:bigint,line:bigint,column:bigint>"


def new_salt() -> str:
    return secrets.token_hex(16)


def placeholder(category: str, literal: Column, salt: str) -> Column:
    digest = F.sha2(F.concat(F.lit(salt), literal).cast("binary"), 256)
    return F.concat(F.lit(f"<REDACTED_{category}_"), F.substring(digest, 1, 16), F.lit(">"))


def masked(category: str, literal: Column, salt: str = "") -> Column:
    """A placeholder without identity."""
    return F.lit(f"<REDACTED_{category}>")


def may_match(text: Column, pattern: Pattern) -> Column:
    out = F.lit(not (pattern.anchors or pattern.hint))
    for anchor in pattern.anchors:
        out = out | text.contains(anchor)
    return out | text.rlike(pattern.hint) if pattern.hint else out


def find_all(text: Column, pattern: Pattern) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern.java), F.lit(0))


def match_count(text: Column, pattern: Pattern) -> Column:
    return F.when(may_match(text, pattern), F.regexp_count(text, F.lit(pattern.java))).otherwise(0).cast("long")


_PLACE = "struct<start:bigint,line:bigint,column:bigint>"


def places(gaps: Column, found: Column) -> Column:
    """start, line (from 1) and column (from 0, in code points) of each match, from the gaps around them in one walk."""

    def piece(x: Column, hit: bool) -> Column:
        lines = F.length(x) - F.length(F.replace(x, F.lit("\n"), F.lit("")))
        return F.struct(F.length(x).alias("n"), lines.alias("lines"), F.length(F.substring_index(x, "\n", -1)).alias("last"), F.lit(hit).alias("hit"))

    def step(at: Column, x: Column) -> Column:
        here = F.array(F.struct(at["start"].alias("start"), at["line"].alias("line"), at["column"].alias("column")))
        return F.struct(
            (at["start"] + x["n"]).alias("start"), (at["line"] + x["lines"]).alias("line"),
            (F.when(x["lines"] > 0, F.lit(0).cast("long")).otherwise(at["column"]) + x["last"]).alias("column"),
            F.when(x["hit"], F.concat(at["out"], here)).otherwise(at["out"]).alias("out"),
        )

    begin = F.struct(F.lit(0).cast("long").alias("start"), F.lit(1).cast("long").alias("line"), F.lit(0).cast("long").alias("column"), F.array().cast(f"array<{_PLACE}>").alias("out"))
    pieces = F.flatten(F.zip_with(F.slice(gaps, 1, F.size(found)), found, lambda g, m: F.array(piece(g, False), piece(m, True))))
    return F.aggregate(pieces, begin, step, lambda at: at["out"])


def positions(df: DataFrame, text: str, pattern: Pattern, *carry: str) -> DataFrame:
    """carry, literal, start, line, column of every match."""
    rows = df.where(may_match(F.col(text), pattern)).select(*carry, F.col(text).alias("_t"), find_all(F.col(text), pattern).alias("_m"), F.split(F.col(text), pattern.java, -1).alias("_g"))
    rows = rows.where(F.size("_m") > 0).select(*carry, F.explode(F.arrays_zip(F.col("_m").alias("literal"), places(F.col("_g"), F.col("_m")).alias("at"))).alias("_x"))
    return rows.select(*carry, "_x.literal", "_x.at.start", "_x.at.line", "_x.at.column")


def _step(df: DataFrame, out: str, pattern: Pattern, number: int, mark: Callable[[Column], Column], changes: str | None) -> DataFrame:
    text = F.col(out)
    df = df.withColumn("_m", F.when(may_match(text, pattern), find_all(text, pattern)))
    hit = F.coalesce(F.size("_m") > 0, F.lit(False))
    df = df.withColumn("_g", F.when(hit, F.split(text, pattern.java, -1)))
    if changes:
        high = pattern.confidence == "high" and pattern.category != "custom"
        found = F.transform(
            F.arrays_zip(F.col("_m").alias("m"), places(F.col("_g"), F.col("_m")).alias("s")),
            lambda x: F.struct(
                F.lit(pattern.category).alias("category"), F.lit(pattern.name).alias("pattern"), F.lit(high).alias("high"), F.lit(number).alias("pass"),
                mark(x["m"]).alias("placeholder"), x["s"]["start"].alias("start"), x["s"]["line"].alias("line"), x["s"]["column"].alias("column"),
            ),
        )
        df = df.withColumn(changes, F.when(hit, F.concat(F.col(changes), found)).otherwise(F.col(changes)))
    joined = F.array_join(F.zip_with("_g", F.concat(F.transform("_m", mark), F.array(F.lit(""))), lambda g, m: F.concat(g, m)), "")
    return df.withColumn(out, F.when(hit, joined).otherwise(text)).drop("_m", "_g")


def _marker(category: str, salt: str, mask: bool) -> Callable[[Column], Column]:
    return (lambda m: masked(category, m)) if mask else (lambda m: placeholder(category, m, salt))


def _held(column: Column) -> Column:
    """The column, in a form through which filters are not pushed.

    Pushing one would put the whole fold into the condition, once per mention and pass.
    """
    return F.when(~F.isnan(F.rand(0)), column)  # unlike monotonically_increasing_id, streams take it


def redact(df: DataFrame, text: str, out: str = "redacted", registry: Registry | None = None, salt: str | None = "", skip=(), changes: str | None = None, mask: bool = False, filters=()) -> DataFrame:
    """df with the redacted text in `out`; null text becomes empty.  salt=None draws a new one.

    `filters` are functions of a column that give a column; they see what the patterns left, in order.

    `changes` names a column for what was replaced: category, pattern, confidence, pass, placeholder
    and place (line from 1, column from 0, in the text that the pass saw), sorted by line and column.
    """
    salt = new_salt() if salt is None else salt
    df = df.withColumn(out, F.coalesce(F.col(text), F.lit("")))
    if changes:
        df = df.withColumn(changes, F.array().cast(f"array<{CHANGE}>"))
    for number, pattern in enumerate((registry or Registry()).without(skip).patterns):
        if mask and not changes:
            mark = f"<REDACTED_{pattern.category}>"
            df = df.withColumn(out, F.when(may_match(F.col(out), pattern), F.regexp_replace(out, pattern.java, mark)).otherwise(F.col(out)))
            continue
        df = _step(df, out, pattern, number, _marker(pattern.category, salt, mask), changes)
    for own in filters:
        df = df.withColumn(out, F.coalesce(own(F.col(out)), F.col(out)))
    df = df.withColumn(out, _held(F.col(out)))
    if changes:
        key = lambda x: F.struct(x["line"].alias("a"), x["column"].alias("b"), x["pass"].alias("c"), x.alias("x"))
        df = df.withColumn(changes, _held(F.transform(F.array_sort(F.transform(changes, key)), lambda y: y["x"])))
    return df


def snippet(redacted: Column, mark: Column, context: int = 40, kept: int = 30) -> Column:
    """The placeholder with what stands around it in the fully redacted text."""
    at = F.instr(redacted, mark)
    before = F.substr(redacted, F.greatest(F.lit(1), at - context), F.least(F.lit(context), at - 1))
    rest = F.substr(redacted, at + F.length(mark))
    after = F.substring(rest, 1, context)
    left = F.when(at - 1 > context, F.concat(F.lit("..."), F.right(before, F.lit(kept)))).otherwise(before)
    right = F.when(F.length(rest) > context, F.concat(F.substring(after, 1, kept), F.lit("..."))).otherwise(after)
    return F.concat(left, mark, right)


def residual(text: Column) -> Column:
    """The first of the residual patterns that hits, at most 60 characters; else null."""
    return F.coalesce(*[F.nullif(F.substring(F.regexp_extract(text, "(?U)" + p, 0), 1, 60), F.lit("")) for p in RESIDUAL])


def unresolved_high(text: Column, registry: Registry | None = None) -> Column:
    """High-confidence matches that are left in a redacted text."""
    patterns = [p for p in (registry or Registry()).patterns if p.confidence == "high" and p.category != "custom"]
    out = F.lit(0).cast("long")
    for p in patterns:
        out = out + match_count(text, p)
    return out
