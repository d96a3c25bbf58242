"""URL rules through a cascade of Bloom filters (DataFrame operations only).

A rule is a host and a path prefix; it fits the host, its subdomains and every path that starts
with the prefix.  So a URL can only be hit through its candidate keys: each host suffix with as
many labels as some rule's host has, joined to each path prefix as long as some rule's path.  The
candidate keys of all URLs are the corpus's complete key universe.

Level 1 of a cascade is a Bloom filter of the listed keys.  Level 2 holds the keys of the universe
that level 1 takes for listed but are not; level 3 the listed keys that level 2 holds wrongly; and
so on until a level has no false member.  A key of the universe is listed exactly if the first level
that lacks it has an even number.  Membership is thus exact, and judging a URL is a handful of bit
tests inside one projection: no join, no shuffle, no Python.

The bits are constants of the plan.  Level 1 is sized from the rules, later levels from the count of
wrong members at one half false positives, so the size follows the rules and the false positives;
`MAX_BITS` is checked before anything is built.  A level's bits stand in the plan once, whatever the number
of candidates and hash functions; with a scratch folder the universe is written once and read by all levels.

Defined cases: a null URL, or one without ``://``, has empty host and path and fits no rule; empty
tables give no rows; repeated rows are judged alike; of rules that fit the longest wins, and of these the
last in code-point order; a very long URL is judged by its host and as much of its path as the longest rule
has; other columns are ignored; no rules: no URL is listed and every verdict is the default.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bits that one level may have: 32 MB, a constant of the plan.
MAX_BITS = 1 << 28


@dataclass
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def key(self) -> str:
        return self.host + self.path


@dataclass
class Cascade:
    """Levels as (words of 64 bits, hash functions)."""

    levels: list[tuple[list[int], int]] = field(default_factory=list)

    def has(self, key: Column) -> Column:
        """True for listed keys, exact for every key of the universe that the cascade was built on."""
        out = F.lit(len(self.levels) % 2 == 1)
        for number in range(len(self.levels), 0, -1):
            words, k = self.levels[number - 1]
            held = _holds(key, words, k, number)
            out = F.when(~held, F.lit(number % 2 == 0)).otherwise(out)
        return out


def _places(key: Column, bits: int, k: int, level: int) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(level), F.lit(j)), F.lit(bits)) for j in range(k)]


def _holds(key: Column, words: list[int], k: int, level: int) -> Column:
    """Whether a level holds the key; its bits stand in the plan once, bound to a name that all its tests use."""
    table = F.split(F.lit(",".join(map(str, words))), ",").cast("array<bigint>")  # folded to one constant

    def tests(bits: Column) -> Column:
        found = [F.call_function("bit_get", F.get(bits, (at / 64).cast("int")), (at % 64).cast("int")) == 1 for at in _places(key, 64 * len(words), k, level)]
        out = found[0]
        for x in found[1:]:
            out = out & x
        return out

    return F.get(F.transform(F.array(table), tests), 0)


def _bloom(keys: DataFrame, n: int, rate: float, level: int) -> tuple[list[int], int]:
    """A filter of the n rows of keys (column key); at most one row per 64 bits reaches the driver."""
    bits = max(64, 64 * math.ceil(-n * math.log(rate) / math.log(2) ** 2 / 64))
    if bits > MAX_BITS:
        raise ValueError(f"a level of {bits} bits exceeds MAX_BITS; split the rules into several cascades")
    k = max(1, round(bits / max(n, 1) * math.log(2))) if n else 1
    k = min(k, 8)
    places = keys.select(F.explode(F.array(*_places(F.col("key"), bits, k, level))).alias("at"))
    found = places.groupBy((F.col("at") / 64).cast("long").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at % 64 as int))")).alias("v")).collect()
    words = [0] * (bits // 64)
    for w, v in found:
        words[w] = v
    return words, k


def _keys(spark: SparkSession, keys: list[str]) -> DataFrame:
    if any("\n" in x for x in keys):
        raise ValueError("a rule holds a newline")
    return spark.range(1).select(F.explode(F.split(F.lit("\n".join(sorted(set(keys)))), "\n")).alias("key"))


def build(spark: SparkSession, listed: list[str], universe: DataFrame, most_levels: int = 64) -> Cascade:
    """`universe` (column key, distinct) is read once per level and shrinks to false positives from level 2 on."""
    cascade = Cascade()
    if not listed:
        return cascade
    yes = _keys(spark, listed)
    no = universe.join(yes, "key", "left_anti")
    n_yes, n_no = len(set(listed)), universe.count()
    sides, counts = [yes, no], [n_yes, n_no]
    level = 1
    while counts[0]:
        if level > most_levels:
            raise RuntimeError("the cascade does not end")
        rate = min(0.5, max(1e-6, n_yes / max(n_no, 1))) if level == 1 else 0.5
        words, k = _bloom(sides[0], counts[0], rate, level)
        cascade.levels.append((words, k))
        wrong = sides[1].where(_holds(F.col("key"), words, k, level))
        sides, counts = [wrong, sides[0]], [wrong.count(), counts[0]]
        level += 1
    return cascade


def parse_url(url: Column) -> tuple[Column, Column]:
    """Host and path after the first ``://``; both empty without one."""
    at = F.instr(F.coalesce(url, F.lit("")), "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    raw = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(raw) + 1), r"^[^?#]*", 0)
    return F.translate(raw, UPPER, LOWER), path


def candidates(host: Column, path: Column, rules: list[Rule]) -> list[Column]:
    labels = sorted({r.host.count(".") + 1 for r in rules})
    lengths = sorted({len(r.path) for r in rules})
    return [F.concat(F.substring_index(host, ".", -n), F.substring(path, 1, size)) for n in labels for size in lengths]


class UrlFilter:
    """A cascade for all rules and one for those that block, over the keys of one corpus."""

    def __init__(self, spark: SparkSession, urls: DataFrame, rules: list[Rule], url_col: str = "url", default: str = "allow", scratch=None):
        self.rules, self.default = rules, default
        host, path = parse_url(F.col(url_col))
        self.keys: DataFrame | None = None
        self.listed, self.blocking = Cascade(), Cascade()
        if rules:
            once = urls.select(host.alias("h"), path.alias("p"))
            universe = once.select(F.explode(F.array(*candidates(F.col("h"), F.col("p"), rules))).alias("key")).distinct()
            universe = scratch.write(universe, "universe") if scratch else universe
            self.listed = build(spark, [r.key for r in rules], universe)
            self.blocking = build(spark, [r.key for r in rules if r.verdict == "block"], universe.join(_keys(spark, [r.key for r in rules]), "key", "left_semi"))

    def judge(self, df: DataFrame, *carry: str, url_col: str = "url") -> DataFrame:
        """carry columns, host, path, rule (the longest that fits, or null) and verdict."""
        host, path = parse_url(F.col(url_col))
        once = df.select(*carry, host.alias("host"), path.alias("path"))
        if not self.rules:
            return once.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(self.default)})
        tried = F.array(*candidates(F.col("host"), F.col("path"), self.rules))
        fits = F.transform(tried, lambda c: F.when(self.listed.has(c), F.struct(F.length(c).alias("n"), c.alias("key"))))
        found = once.withColumn("rule", F.array_max(fits)["key"])
        verdict = F.when(F.col("rule").isNull(), F.lit(self.default)).when(self.blocking.has(F.col("rule")), "block").otherwise("allow")
        return found.withColumn("verdict", verdict)
