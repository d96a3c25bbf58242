"""Every stage of corpus_pipeline on the output of the one before, and the whole run, on a small corpus."""

import sys
from collections import Counter
from pathlib import Path

from brute import components, mutate, prose, rng
from pyspark.sql import functions as F
from test_dedup import brute_lines
from test_text import leaks

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline as P  # noqa: E402

from logbrook.llm import mixing, toxicity  # noqa: E402
from logbrook.llm.scratch import Scratch  # noqa: E402

SCHEMA = "doc_id long, text string, source string, n_chars int"


def corpus(g):
    bad = ["rotten", "vile", "nasty"]
    items = [(1, prose(g, 14, 10**6)), (2, prose(g, 30, 10**6))]
    common = [f"common line {k} of many sites" for k in range(3)]
    rows, labels = [], []
    for i in range(600):
        text, toxic = prose(g, 30, 3000) + "\n" + prose(g, 30, 3000), i % 6 == 0
        if toxic:
            text = text.replace(" ", f" {g.choice(bad)}, ", 2)
        rows.append((i, text + "".join("\n" + c for k, c in enumerate(common) if g.random() < 0.1 * (k + 1)), f"s{i % 12}"))
        labels.append((i, int(toxic)))
    rows += [(1000 + i, mutate(g, rows[7 * i + 1][1], 0.005), "s3") for i in range(40)]
    rows += [(2000 + i, prose(g, 20, 3000) + " " + items[i % 2][1] + " " + prose(g, 5, 3000), "s4") for i in range(20)]
    rows += [(3000, None, "s1"), (3001, "", None), (None, prose(g, 40, 3000), "s2")]
    return [(i, t, s, len(t or "")) for i, t, s in rows], labels, items


def kept(df):
    return Counter((r.doc_id, r.text, r.source, r.n_chars) for r in df.collect())


def test_stages_and_run_equal_brute_force(spark, tmp_path):
    rows, labels, items = corpus(rng(31))
    at = str(tmp_path)
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    stages = dict(P.STAGES)
    assert list(stages) == ["toxicity", "line_dedup", "near_dedup", "decontamination", "mixing"]
    docs = spark.createDataFrame(rows, SCHEMA)

    model = toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    scores = Counter((r.doc_id, r.text, r.source, r.n_chars) for r in toxicity.score(docs, model, name="x").where(F.col("x") < 0.5).collect())
    now = kept(stages["toxicity"](spark, docs, at))
    assert now == scores and 0 < sum(now.values()) < len(rows)

    before = list(now.elements())
    now = kept(stages["line_dedup"](spark, spark.createDataFrame(before, SCHEMA), at))
    cut = list(brute_lines([(n, t, s) for n, (_, t, s, _) in enumerate(before)], 10).values())
    assert now == Counter((i, c, s, n if c == t else len(c)) for (i, t, s, n), c in zip(before, cut))
    assert cut != [x[1] for x in before]

    before = list(now.elements())
    now = kept(stages["near_dedup"](spark, spark.createDataFrame(before, SCHEMA), at))
    roots = components([(i, t) for i, t, _, _ in before if i is not None])
    assert now == Counter(x for x in before if x[0] is None or roots[x[0]] == x[0]) and sum(now.values()) < len(before)

    before = list(now.elements())
    now = kept(stages["decontamination"](spark, spark.createDataFrame(before, SCHEMA), at))
    hit = leaks([(n, t) for n, (_, t, _, _) in enumerate(before)], items)
    assert now == Counter(x for n, x in enumerate(before) if not hit[n][1]) and sum(now.values()) < len(before)

    last = spark.createDataFrame(list(now.elements()), SCHEMA)
    mixed = stages["mixing"](spark, last, at).collect()
    copies = {r.id: r.copies for r in mixing.mix(last, Scratch(spark, "mix")).collect()}
    assert Counter(r.doc_id for r in mixed) == Counter({i: n for i, n in copies.items() if n})
    assert len({(r.doc_id, r.copy) for r in mixed}) == len(mixed)
    assert {(r.doc_id, r.text, r.source, r.n_chars) for r in mixed} <= set(now)

    whole = P.run(spark, at).collect()
    assert Counter((r.doc_id, r.copy, r.text) for r in whole) == Counter((r.doc_id, r.copy, r.text) for r in mixed)
