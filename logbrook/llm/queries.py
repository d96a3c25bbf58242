"""The queries opN_<name> and the SQL that gives the same rows, where SQL can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate as _leaks
from . import exact_dedup as _exact
from . import line_dedup as _lines
from . import lm_score as _lm
from . import mixing as _mixing
from . import near_dedup as _near
from . import substring_dedup as _substring
from . import toxicity as _toxic
from . import url_filter as _urls
from . import warc as _warc
from .scratch import Scratch, plan_bytes


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


RULES = [
    _urls.Rule("com", "/en/", "block"),
    _urls.Rule("example.com", "/en/7", "allow"),
    _urls.Rule("net", "/de/", "allow"),
    _urls.Rule("example.net", "/de/8", "block"),
    _urls.Rule("org", "/es/", "block"),
]


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _substring.passages(table(spark, sf_dir, "documents").select("doc_id", "text"), Scratch(spark, "substring-dedup"))
    return found.withColumnsRenamed({"id": "doc_id", "anchor": "first_doc_id", "anchor_start": "first_start", "anchor_end": "first_end"})


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    found = _lines.line_dedup(docs, Scratch(spark, "line-dedup"))
    sha = F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256)
    return found.select("doc_id", F.col("__n_lines").alias("n_lines"), F.col("__n_cut").alias("n_cut"), sha.alias("text_sha256"))


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _near.near_components(table(spark, sf_dir, "documents").select("doc_id", "text"), Scratch(spark, "near-dedup"))
    kept = F.coalesce(F.col("id") == F.col("component"), F.lit(False))
    return found.select(F.col("id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"), kept.alias("kept"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "html")
    return _warc.round_trip(pages, Scratch(spark, "warc")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _lm.score(table(spark, sf_dir, "documents").select("doc_id", "text"), Scratch(spark, "lm-score"))
    return found.withColumnRenamed("id", "doc_id")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = _leaks.judge(docs, table(spark, sf_dir, "benchmark"))
    sha = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    return found.select(F.col("id").alias("doc_id"), "n_words", "n_hit", "n_items", sha.alias("items_sha256"), "contaminated")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = _toxic.score(docs, _toxic.train(docs, table(spark, sf_dir, "labels")))
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 == 0
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _mixing.mix(table(spark, sf_dir, "documents"), Scratch(spark, "mixing"))
    return found.withColumnRenamed("id", "doc_id")


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark, "exact-dedup")
    index = _exact.DigestIndex(spark, f"{scratch.path}/index", buckets=max(16, min(65536, plan_bytes(docs) >> 31)))
    found = _exact.exact_dedup(docs, index, lambda rows: scratch.write(rows, "digests"))
    return found.select(F.col("id").alias("doc_id"), "keep_id", F.col("copies").alias("group_size"), "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return _urls.UrlFilter(spark, pages, RULES, scratch=Scratch(spark, "url-filter")).judge(pages, "page_id")


QUERIES = {f.__name__: f for f in (op1_substring_dedup, op2_line_dedup, op3_near_dedup, op4_warc, op5_lm_score, op6_decontamination, op7_toxicity, op8_mixing, op9_exact_dedup, op10_url_filter)}

_SPACE = "[\\x20\\x09-\\x0D]"

_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

_TRIM = "regexp_replace(regexp_replace({}, '^[\\x20\\x09-\\x0D]+', ''), '[\\x20\\x09-\\x0D]+$', '')"

ORACLE = {
    "op2_line_dedup": f"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
        l AS (SELECT r, source, p, ls[p] AS raw, {_TRIM.format("ls[p]")} AS line FROM (SELECT r, source, ls, unnest(range(1, len(ls) + 1)) AS p FROM d)),
        b AS (SELECT line FROM l WHERE line <> '' GROUP BY line HAVING count(DISTINCT coalesce('=' || source, '')) >= 10),
        m AS (SELECT l.r, p, raw, line, line IN (SELECT line FROM b) AS bad FROM l),
        s AS (SELECT r, count(*) FILTER (line <> '') AS n_lines, sum(strlen(line)) AS total, coalesce(sum(strlen(line)) FILTER (bad), 0) AS lost,
                     count(*) FILTER (bad) AS n_bad FROM m GROUP BY r),
        k AS (SELECT r, n_lines, lost > 0 AND lost < total AS cut, n_bad FROM s),
        t AS (SELECT m.r, string_agg(raw, chr(10) ORDER BY p) FILTER (NOT (cut AND bad)) AS body, max(p) AS last_p,
                     max(p) FILTER (NOT (cut AND bad)) AS last_kept FROM m JOIN k USING (r) GROUP BY m.r)
        SELECT doc_id, n_lines, CASE WHEN cut THEN n_bad ELSE 0 END AS n_cut,
               sha256(coalesce(body, '') || CASE WHEN last_kept < last_p THEN chr(10) ELSE '' END) AS text_sha256
        FROM d JOIN k USING (r) JOIN t USING (r)""",
    "op3_near_dedup": """
        WITH RECURSIVE
        w AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
        s AS (SELECT DISTINCT r, doc_id, array_to_string(list_slice(w, p, p + least(5, len(w)) - 1), ' ') AS g
              FROM (SELECT r, doc_id, w, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS p FROM w WHERE len(w) > 0)),
        n AS (SELECT r, doc_id, count(*) AS n FROM s GROUP BY r, doc_id),
        c AS (SELECT x.r AS a, y.r AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.r <> y.r GROUP BY x.r, y.r),
        l AS (SELECT DISTINCT na.doc_id AS a, nb.doc_id AS b FROM c JOIN n na ON na.r = c.a JOIN n nb ON nb.r = c.b WHERE 100 * k >= 75 * (na.n + nb.n - k)),
        reach(a, b) AS (SELECT a, b FROM l UNION SELECT reach.a, l.b FROM reach JOIN l ON reach.b = l.a),
        m AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
        SELECT w.doc_id, cast(coalesce(n.n, 0) AS bigint) AS n_shingles, least(w.doc_id, coalesce(m.b, w.doc_id)) AS component_id,
               least(w.doc_id, coalesce(m.b, w.doc_id)) = w.doc_id AS kept
        FROM w LEFT JOIN n ON n.r = w.r LEFT JOIN m ON m.a = w.doc_id""",
    "op4_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
        h AS (SELECT page_id, strlen(body) AS payload_bytes, sha1(body) AS x, max(page_id) OVER (PARTITION BY body) AS best FROM p)
        SELECT page_id, payload_bytes,
               array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                 cast(((cast('0x' || substr(x, cast((i // 8) * 10 + 1 AS int), 10) AS bigint) >> cast(35 - 5 * (i % 8) AS int)) & 31) + 1 AS int), 1)), '') AS payload_digest,
               CASE WHEN page_id = best THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id = best THEN NULL ELSE best END AS refers_to
        FROM h""",
    "op6_decontamination": f"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
        i AS (SELECT cast(item_id AS varchar) AS item, {_WORDS} AS w FROM benchmark),
        iw AS (SELECT DISTINCT item, least(10, len(w)) AS n, list_slice(w, p, p + least(10, len(w)) - 1) AS win
               FROM (SELECT item, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS p FROM i WHERE len(w) > 0)),
        dw AS (SELECT r, p, n, list_slice(w, p, p + n - 1) AS win
               FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, (SELECT DISTINCT n FROM iw) WHERE len(w) >= n)),
        hit AS (SELECT dw.r, dw.p, dw.n, iw.item FROM dw JOIN iw ON dw.n = iw.n AND dw.win = iw.win),
        cov AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(p, p + n)) AS q FROM (SELECT DISTINCT r, p, n FROM hit)) GROUP BY r),
        its AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT r, item FROM hit) GROUP BY r)
        SELECT doc_id, cast(len(w) AS bigint) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
               sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN cov USING (r) LEFT JOIN its USING (r)""",
    "op9_exact_dedup": f"""
        WITH d AS (
          SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '{_SPACE}', '', 'g')) AS text_sha256
          FROM documents)
        SELECT doc_id,
               first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id
                 ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS keep_id,
               count(*) OVER (PARTITION BY text_sha256) AS group_size,
               doc_id = first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id
                 ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS kept,
               text_sha256
        FROM d""",
    "op10_url_filter": """
        WITH r(h, p, v) AS (VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'),
                                   ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
        a AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
        b AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM a),
        c AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                     regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM b),
        f AS (SELECT page_id, host, path, (SELECT max(printf('%09d', length(h || p)) || h || p || '|' || v) FROM r
                WHERE (c.host = h OR ends_with(c.host, '.' || h)) AND starts_with(c.path, p)) AS best FROM c)
        SELECT page_id, host, path, split_part(substr(best, 10), '|', 1) AS rule,
               coalesce(split_part(best, '|', 2), 'allow') AS verdict FROM f""",
    "op8_mixing": None,
}
