import hashlib
import math
import time
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from brute import alnum, fold, prose, rng, words

from pyspark.sql import functions as F

from logbrook.llm import decontaminate, lm_score, mixing, toxicity, url_filter, warc

DATA = "/root/testdata/sf0.001"


def leaks(rows, items, window=10):
    out = {}
    for i, t in rows:
        w, hit, found = alnum(t), set(), set()
        for name, x in items:
            iw = alnum(x)
            n = min(window, len(iw))
            for p in range(len(iw) - n + 1 if n else 0):
                for q in range(len(w) - n + 1):
                    if w[q : q + n] == iw[p : p + n]:
                        hit |= set(range(q, q + n))
                        found.add(str(name))
        out[i] = (len(w), len(hit), sorted(found))
    return out


@pytest.mark.parametrize("block_words", [10**6, 15])
def test_decontamination_equals_brute_force(spark, docs, block_words):
    g = rng(8)
    items = [(10, prose(g, 14, 50)), (2, prose(g, 30, 50)), (3, "w1x w2x"), (3, prose(g, 11, 50)), (4, ""), (5, None), (6, "Ünï-code é")]
    rows = [(i, prose(g, 25, 50) + " " + " ".join(alnum(items[k % 2][1])[k % 5 : k % 5 + 12]) + ". " + prose(g, 5, 50)) for i, k in enumerate(range(20))]
    rows += [(100, None), (101, ""), (102, items[1][1].upper()), (103, items[1][1] + " " + items[1][1]), (104, prose(g, 3000, 10**6)), (105, "x ünï CODE É y"), (100, None)]
    bench = spark.createDataFrame(items + [(None, "w7x w8x w9x")], "item_id long, text string")
    found = decontaminate.judge(docs(rows), bench, block_words=block_words).collect()
    assert {r.id: (r.n_words, r.n_hit, r.items) for r in found} == leaks(rows, [x for x in items if x[1]])
    assert len(found) == len(rows)
    longest = {r.id: r.longest for r in found}
    assert longest[102].words == 30 and longest[104] is None and longest[103].item == "2"
    clean = decontaminate.clean(docs(rows), bench, block_words=block_words)
    assert clean.columns == docs(rows).columns and {r.doc_id for r in clean.collect()} == {k for k, v in leaks(rows, [x for x in items if x[1]]).items() if not v[1]}


def test_decontamination_without_items_or_documents(spark, docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert [r.n_hit for r in decontaminate.judge(docs([(1, "a b")]), none).collect()] == [0]
    assert decontaminate.judge(docs([]), spark.createDataFrame([(1, "a")], "item_id long, text string")).count() == 0


def test_toxicity_held_out(spark, docs):
    g = rng(9)
    bad = ["rotten", "vile", "nasty"]
    rows, labels = [], []
    for i in range(1500):
        text, toxic = prose(g, 60, 3000), i % 6 == 0
        rows.append((i, text.replace(" ", f" {g.choice(bad)}, ", 2) if toxic else text))
        labels.append((i, int(toxic)))
    rows += [(5000, None), (5001, ""), (5002, prose(g, 20000, 3000) + " vile"), (5000, None)]
    table = spark.createDataFrame([*labels, (1, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.train(docs(rows), table)
    scored = toxicity.score(docs(rows), model)
    assert scored.columns == [*docs(rows).columns, "score"]
    found = {r.doc_id: r.score for r in scored.collect()}
    held = [i for i, _ in labels if fold(i, 5) == 0]
    assert sum((found[i] >= 0.5) == (i % 6 == 0) for i in held) / len(held) > 0.97
    assert len(model[0]) < 3000 and 0 <= found[5000] < 0.5 and found[5000] == found[5001]


def test_toxicity_without_labels(spark, docs):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.score(docs([(1, "a")]), toxicity.train(docs([(1, "a")]), none)).first().score < 0.5


def test_mixing(spark, docs, scratch):
    g = rng(10)
    rows = [(i, prose(g, g.randrange(1, 40)), ["a", "b", "c", None, "e"][min(4, i % 9)]) for i in range(900)]
    rows += [(2000, None, "a"), (2001, "", "z"), (0, rows[0][1], "a")]
    found = mixing.mix(docs(rows), scratch).collect()
    assert len(found) == len(rows)
    sizes, taken, target, source = Counter(), Counter(), {}, {}
    for (i, t, s), _ in zip(rows, found):
        sizes[s] += len(words(t))
        source[i] = s
    for r in found:
        s = source[r.id]
        taken[s] += r.taken
        target[s] = r.target
        assert r.source_size == sizes[s] and r.taken in (0, r.size, 2 * r.size)
    order = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    left, free, aims = 1.5 * sum(sizes.values()), set(order), {}
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * level > 2 * sizes[s]}
        for s in over or free:
            aims[s] = 2.0 * sizes[s] if over else weight[s] * level
        left -= sum(aims[s] for s in over)
        free = free - over if over else set()
    for s in order:
        assert math.isclose(target[s], aims[s], rel_tol=1e-9, abs_tol=1e-9)
        assert abs(taken[s] - aims[s]) <= 40
    again = mixing.mix(docs(rows), type(scratch)(spark, "again")).collect()
    assert sorted((r.id, r.taken) for r in again) == sorted((r.id, r.taken) for r in found)
    copies = mixing.mixed_rows(docs(rows), type(scratch)(spark, "rows"))
    assert copies.columns == [*docs(rows).columns, "copy"]
    assert copies.count() == sum(r.copies for r in found)


def test_water_level_without_the_driver(spark, monkeypatch):
    table = spark.createDataFrame([(3, 10.0), (1, 50.0), (2, 8.0), (3, 90.0), (1, 90.0)], "weight int, cap double")
    expected = mixing.water_level(table, 120.0)
    monkeypatch.setattr(mixing, "DRIVER_ROWS", 0)
    assert math.isclose(mixing.water_level(table, 120.0), expected) and mixing.water_level(table, 1e6) == float("inf")


def test_decontamination_in_passes_with_clashing_columns(spark, docs, monkeypatch):
    monkeypatch.setattr(decontaminate, "AT_ONCE", 2)
    g = rng(12)
    items = [(k, prose(g, 12, 10**6)) for k in range(7)]
    rows = [(i, prose(g, 8, 10**6) + " " + items[i % 7][1] + " " + items[(3 * i) % 7][1]) for i in range(14)] + [(99, prose(g, 40000, 10**6) + " " + items[2][1])]
    df = docs(rows).withColumns({c: F.lit("mine") for c in (*decontaminate.FOUND_AS, "items", "n_hit")})
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.judge(df, bench, block_words=13).collect()
    assert {r.id: (r.n_words, r.n_hit, r.items) for r in found} == leaks(rows, items)
    assert decontaminate.clean(df, bench, block_words=13).columns == df.columns


def test_toxicity_equals_a_plain_learner(spark, docs):
    import numpy as np
    import pyarrow as pa

    from logbrook.llm import kernels as K

    g = rng(24)
    rows = [(i, prose(g, g.randrange(0, 30), 60) + (" vile thing" if i % 4 == 0 else "")) for i in range(120)]
    labels = [(i, int(i % 4 == 0)) for i in range(0, 120, 2)] + [(6, 1), (8, None)]
    table = spark.createDataFrame(labels, "doc_id long, toxic int")

    def places(text):
        data, offsets = K.buffers(pa.array([text], pa.string()))
        found = sorted(set(toxicity.features(K.tokenize(data, offsets, K.ALNUM))[1].tolist()))
        w = alnum(text)
        plain = {(x,) for x in w} | {(w[i], w[i + 1], 1) for i in range(len(w) - 1)} | {(w[i], w[i + n], 2) for n in (2, 3) for i in range(len(w) - n)}
        assert len(plain) - 2 <= len(found) <= len(plain)  # two places may be one
        return [*found, 1 << toxicity.BITS]

    def weight(z, n, bias):
        if not bias and abs(z) <= toxicity.L1:
            return 0.0
        return -(z - math.copysign(0.0 if bias else toxicity.L1, z)) / ((toxicity.BETA + math.sqrt(n)) / toxicity.ALPHA + toxicity.L2)

    label = {}
    for i, x in labels:
        if x is not None and fold(i, 5):
            label[i] = max(x, label.get(i, 0))
    order = {r.i: r.h for r in spark.createDataFrame([(i,) for i in label], "i long").select("i", F.xxhash64("i", F.lit(7)).alias("h")).collect()}
    z, n = {}, {}
    for i in sorted(label, key=lambda i: order[i]):
        at = places(rows[i][1])
        w = {p: weight(z.get(p, 0.0), n.get(p, 0.0), p == 1 << toxicity.BITS) for p in at}
        grad = 1 / (1 + math.exp(-sum(w.values()))) - label[i]
        for p in at:
            old = n.get(p, 0.0)
            n[p] = old + grad * grad
            z[p] = z.get(p, 0.0) + grad - (math.sqrt(n[p]) - math.sqrt(old)) / toxicity.ALPHA * w[p]
    plain = {p: weight(z[p], n[p], p == 1 << toxicity.BITS) for p in z}
    plain = {p: w for p, w in plain.items() if w}
    model = toxicity.train(docs(rows), table)
    found = dict(zip(model[0].tolist(), model[1].tolist()))
    assert set(found) == set(plain) and all(math.isclose(found[p], plain[p], rel_tol=1e-5, abs_tol=1e-6) for p in plain)
    scores = {r.doc_id: r.score for r in toxicity.score(docs(rows), model).collect()}
    for i, t in rows:
        assert math.isclose(scores[i], 1 / (1 + math.exp(-sum(plain.get(p, 0.0) for p in places(t)))), rel_tol=1e-4)
    assert np.isfinite(model[1]).all()


def test_toxicity_bound_counts_rows_and_columns_may_clash(spark, docs):
    rows = [(i, f"text {i} vile", "s") for i in range(4) for _ in range(1000)] + [(7, "alone vile", "s"), (9, "other", "s")]
    table = spark.createDataFrame([(i, 1) for i in range(10)], "doc_id long, toxic int")
    assert toxicity.training_rows(docs(rows), table, "doc_id", "text", 2, False).count() <= 2
    df = docs(rows[-2:]).withColumn("score", F.lit("mine"))
    out = toxicity.score(df, toxicity.train(df, table))
    assert out.columns == [*df.columns, "score_1"] and {r.score for r in out.collect()} == {"mine"}
    assert toxicity.score(docs([]), toxicity.train(docs([]), table)).count() == 0


def plain_mix(rows, odds, share=1.5, most=2.0):
    """copies by (id, source, size) of a sampler that sorts every source; rows: (id, source, size)."""
    sizes = {}
    for _, s, n in rows:
        sizes[s] = sizes.get(s, 0) + n
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    target, left, open_ = {}, share * sum(sizes.values()), {s for s in sizes if sizes[s]}
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > most * sizes[s]}
        for s in over or open_:
            target[s] = most * sizes[s] if over else level * weight[s]
            left -= target[s]
        open_ = open_ - over if over else set()
    out = []
    for s in order:
        own = [(i, n) for i, t, n in rows if t == s]
        low, high = 0.0, 1e9
        for _ in range(300):
            mid = (low + high) / 2
            low, high = (mid, high) if sum(n * min(most, mid * n) for _, n in own) < target.get(s, 0) else (low, mid)
        share_ = {(i, n): min(most, high * n) if n and target.get(s) else 0.0 for i, n in own}
        whole = {k: int(c + 1e-9) for k, c in share_.items()}
        chance = {k: c - whole[k] for k, c in share_.items()}
        missing = target.get(s, 0) - sum(whole[i, n] * n for i, n in own)
        ranked = sorted((odds[i] * (1 - chance[i, n]) / chance[i, n], i, n) for i, n in own if chance[i, n] > 1e-9 and n)
        taken, last = 0, -1
        for k, (_, _, n) in enumerate(ranked):
            if taken + n / 2 <= missing:
                last = k
            taken += n
        more = {(i, n) for _, i, n in ranked[: last + 1]}
        out += [(i, s, n, whole[i, n] + ((i, n) in more)) for i, n in own]
    return target, out


def test_mixing_equals_a_plain_sampler(spark, docs, scratch):
    g = rng(23)
    rows = [(i, prose(g, g.choice([1, 5, 20, 60, 400]), 50), g.choice(["a", "b", "c", "d", None, "a", "a"])) for i in range(700)]
    rows += [(5000, prose(g, 20000, 50), "b"), (5001, None, "c"), (5002, "", "empty"), (1, rows[1][1], rows[1][2]), (6000, "one two", "tiny"), (-5, prose(g, 7, 50), "é")]
    sized = [(i, s, len(words(t))) for i, t, s in rows]
    odds = {r.i: r.o for r in spark.createDataFrame([(i,) for i, _, _ in sized], "i long").distinct().select("i", mixing._odds(F.col("i"), 8).alias("o")).collect()}
    target, expected = plain_mix(sized, odds)
    found = mixing.mix(docs(rows), scratch).collect()
    source = {(i, n): s for i, s, n in sized}
    assert Counter((r.id, source[r.id, r.size], r.size, r.copies) for r in found) == Counter(expected)
    for r in found:
        assert math.isclose(r.target, target.get(source[r.id, r.size], 0.0), rel_tol=1e-9, abs_tol=1e-9)
    likely = [r.copies for r in found if r.size == 400 and source[r.id, 400] == "a"], [r.copies for r in found if r.size == 5 and source[r.id, 5] == "a"]
    assert sum(likely[0]) / len(likely[0]) > sum(likely[1]) / len(likely[1])


def test_mixed_rows_keep_a_column_named_copy(docs, scratch):
    df = docs([(i, "a b c", "s") for i in range(8)]).withColumn("copy", F.lit("mine"))
    out = mixing.mixed_rows(df, scratch)
    assert out.columns == [*df.columns, "copy_1"] and {r["copy"] for r in out.collect()} == {"mine"}


def test_mixing_nothing(docs, scratch):
    assert mixing.mix(docs([]), scratch).count() == 0


def test_lm_counts_and_gain(spark, docs, scratch):
    g = rng(11)
    tongue = [[f"{c}{k}{c}" for k in range(300)] for c in "aeo"]
    rows = [(i, " ".join(g.choice(tongue[i % 3][: g.randrange(1, 300)]) for _ in range(60))) for i in range(400)]
    rows += [(900, None), (901, ""), (902, "A B\tc"), (None, "x"), (0, rows[0][1])]
    found = lm_score.score(docs(rows), scratch).collect()
    assert len(found) == len(rows)
    text = {}
    train = Counter()
    for i, t in rows:
        text[i] = [*words(t), "</>"]
        if fold(i, 10):
            train.update(text[i])
    total, kinds = sum(train.values()), len(train)
    for r in found:
        w = text[r.id]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(w), sum(train[x] > 0 for x in w), total, fold(r.id, 10) == 0)
        assert math.isclose(r.base_score, sum(math.log10((train[x] + 0.1) / (total + 0.1 * (kinds + 1))) for x in w), rel_tol=1e-9)
    held = [r for r in found if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def restaurants(g, n_words=60, bits=8):
    import numpy as np

    from logbrook.llm import kernels as K

    keys = np.array(sorted((w << 16) | u for w in range(1, n_words) for u in range(1, 1 << bits) if g.random() < 0.1), np.uint64)
    counts = np.array([g.choice([1, 1, 2, 3, 8, 9, 40, 700]) for _ in keys], np.int64)
    context = (keys & K.U64(0xFFFF)).astype(int)
    world = {"customers": np.bincount(context, counts, 1 << bits), "tables": np.bincount(context, minlength=1 << bits), "types": n_words - 1, "tokens": int(counts.sum()), "discount": 0.6, "root_discount": 0.4}
    return keys, counts, context, world | {"root_customers": len(keys), "root_tables": n_words - 1}


def test_lm_probabilities_sum_to_one_on_the_answering_path():
    import numpy as np

    keys, counts, context, world = restaurants(rng(3))
    r = lm_score.Restaurants(0, keys, counts, world)
    worlds, kept, n = [], b"", len(r.words)
    for number in range(4):
        r.sweep()
        sizes, tables = r.seated()
        at = np.cumsum(tables) - tables
        assert (np.add.reduceat(sizes, at) == counts).all() and (tables >= 1).all() and (tables <= counts).all() and (sizes >= 1).all()
        assert (r.root.customers() == np.bincount(r.word, tables)).all()
        kept += tables.astype(np.int32).tobytes() + r.root.tables().astype(np.int32).tobytes()
        worlds.append(world | {"tables": np.bincount(context, tables, 256).astype(int), "root_tables": int(r.root.tables().sum()), "root_customers": int(tables.sum())})
        r = lm_score.Restaurants(0, keys, counts, worlds[-1], number + 1, (sizes, tables), (r.root.size, r.root.tables()))
    seen, fresh, lost, backs = lm_score.predictive(worlds, keys, counts, kept)
    for u in range(256):
        own = context == u
        rest = np.setdiff1d(np.arange(n), r.word[own])
        unseen = sum(backs[k][u] * (fresh[k][rest].sum() + lost[k]) for k in range(4)) / 4
        assert math.isclose(seen[own].sum() + unseen, 1, rel_tol=1e-9)


def test_lm_table_counts_follow_the_restaurant():
    """The number of tables of one dish against its exact distribution, from one-by-one seating and from shares."""
    import numpy as np

    d, new = 0.5, 0.8
    for count, rounds in ((6, "one"), (30, "share")):
        weight = {1: 1.0}  # by table count: sum over seatings of the product of (s - d) factors
        for n in range(1, count):
            nxt = {}
            for t, w in weight.items():
                nxt[t] = nxt.get(t, 0.0) + w * (n - t * d)
                nxt[t + 1] = nxt.get(t + 1, 0.0) + w
            weight = nxt
        exact = {t: w * new**t for t, w in weight.items()}
        mean = sum(t * w for t, w in exact.items()) / sum(exact.values())
        dishes = 4000
        seats = lm_score.Seats(np.random.default_rng(1), dishes, np.arange(dishes), np.full(dishes, count))
        who = np.arange(dishes)
        for _ in range(6):
            for _ in range(count if rounds == "one" else lm_score.ROUNDS):
                if rounds == "one":
                    seats.leave(who)
                    seats.sit(who, d, np.full(dishes, new))
                else:
                    gone = seats.leave_share(1 / lm_score.ROUNDS)
                    some = np.flatnonzero(gone)
                    seats.sit_many(some, gone[some], d, np.full(len(some), new))
        assert (seats.customers() == count).all()
        assert abs(seats.tables().mean() - mean) < (0.05 if rounds == "one" else 0.15) * mean, (count, seats.tables().mean(), mean)


def test_lm_totals_are_few_rows_however_many_parts(monkeypatch):
    monkeypatch.setattr(lm_score, "BLOCK", 64)
    g = np.random.default_rng(8)
    ints = lambda x: np.asarray(x, np.int32).tobytes()
    customers, tables, rows = np.zeros(256, np.int64), np.zeros(256, np.int64), []
    for part in range(40):
        context, count = np.sort(g.integers(0, 256, 300)), g.integers(1, 9, 300)
        mine = g.integers(1, count + 1)
        np.add.at(customers, context, count)
        np.add.at(tables, context, mine)
        rows.append((context.astype(np.uint64).tobytes(), count.tobytes(), ints(mine), ints([2, part])))
    names = ["keys", "counts", "tables", "root_tables"]
    batches = [pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*rows[at : at + 8])], names=names) for at in range(0, 40, 8)]
    found = [lm_score._totals(8)(iter(x)) for x in (batches[:2], batches[2:])]
    found = pa.Table.from_batches([b for x in found for b in x])
    assert found.num_rows == 2 * (256 // 64 + 1)  # of two tasks
    for block in range(4):
        summed = lm_score._summed(found.filter(pc.equal(found["block"], block))).to_pylist()[0]
        assert np.array_equal(np.frombuffer(summed["customers"], np.int64), customers[64 * block : 64 * block + 64])
        assert np.array_equal(np.frombuffer(summed["tables"], np.int64), tables[64 * block : 64 * block + 64])
    root = lm_score._summed(found.filter(pc.equal(found["block"], -1))).to_pylist()[0]
    assert np.frombuffer(root["tables"], np.int64).tolist() == [40 * 2 + sum(range(40))]


def test_lm_sweeps_read_the_files_of_the_one_before(spark, docs, scratch, monkeypatch):
    rows = scratch.write(docs([(i, f"a b c w{i} x{i % 7}") for i in range(300)]), "rows")  # files have a known size, so parts are few
    plans, parts, write = {}, {}, scratch.write

    def watched(df, name):
        plans[name], parts[name] = df._jdf.queryExecution().executedPlan().toString(), df.rdd.getNumPartitions() if name == "state-2" else 0
        return write(df, name)

    monkeypatch.setattr(scratch, "write", watched)
    before = spark.conf.get("spark.sql.files.openCostInBytes")
    assert lm_score.score(rows, scratch).count() == 300
    assert "Exchange" in plans["state-0"] and not any("Exchange" in plans[f"state-{k}"] for k in (1, 2, 3))
    assert parts["state-2"] > 1  # the files are small, yet not in one task
    assert spark.conf.get("spark.sql.files.openCostInBytes") == before


def test_lm_in_groups_of_slices_and_empty_tables(spark, docs, scratch, monkeypatch):
    g = rng(13)
    rows = [(i, prose(g, 40, 50)) for i in range(200)] + [(300, prose(g, 30000, 50))]
    whole = {r.id: r for r in lm_score.score(docs(rows), scratch).collect()}
    monkeypatch.setattr(lm_score, "SLICE_BYTES", 2000)
    monkeypatch.setattr(lm_score, "FAN", 2)
    cut = {r.id: r for r in lm_score.score(docs(rows), type(scratch)(spark, "cut")).collect()}
    for i, r in whole.items():
        assert (r.n_tokens, r.n_known, r.train_tokens) == (cut[i].n_tokens, cut[i].n_known, cut[i].train_tokens) and math.isclose(r.base_score, cut[i].base_score, rel_tol=1e-9)
        assert math.isclose(r.score, cut[i].score, rel_tol=1e-3)
    assert lm_score.score(docs([]), type(scratch)(spark, "none")).count() == 0
    only = lm_score.score(docs([(i, "a b") for i in range(200) if fold(i, 10) == 0]), type(scratch)(spark, "held")).collect()
    assert only and all(r.train_tokens == 0 and r.n_known == 0 and math.isclose(r.score, 0.0, abs_tol=1e-6) for r in only)


def test_lm_passes_leave_no_shuffle_files_or_answers(spark, docs, scratch, monkeypatch):
    assert lm_score._passes([]) == [(0, 0)] and lm_score._passes([5, 7]) == [(5, 7)]
    for n in (8, 23, 24, 118, 7500):
        found = lm_score._passes(list(range(0, 3 * n, 3)))
        assert [a for a, _ in found] == [0, *[b + 3 for _, b in found[:-1]]] and found[-1][1] == 3 * n - 3  # each slice in one pass
        assert max(b - a for a, b in found) // 3 < lm_score.ASKING * lm_score.FAN and len(found) == max(min(3, n // 8), -(-n // 512))
    g = rng(14)
    rows = scratch.write(docs([(i, prose(g, 40, 50)) for i in range(100)]), "rows")  # files have a known size, so parts are few
    whole = {r.id: r for r in lm_score.score(rows, scratch).collect()}
    monkeypatch.setattr(lm_score, "SLICE_BYTES", 2000)
    monkeypatch.setattr(lm_score, "LEAST", 2)
    folders = [str(x) for x in spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    files = lambda: {f for d in folders for f in Path(d).rglob("shuffle_*")}
    again, left, there = type(scratch)(spark, "passes"), files(), {}
    write = again.write

    def watched(df, name):
        there[name] = {x.name for x in Path(again.path.removeprefix("file:")).glob("*")}
        return write(df, name)

    monkeypatch.setattr(again, "write", watched)
    found = lm_score.score(rows, again)
    cut = {r.id: r for r in found.collect()}
    assert {"answers-0", "answers-1", "answers-2"} <= set(there) and there["answers-2"] == {"index", "state-3", "scores-0", "scores-1"}
    assert whole.keys() == cut.keys() and all(whole[i][:6] == pytest.approx(cut[i][:6], rel=1e-9) and math.isclose(whole[i].score, cut[i].score, rel_tol=1e-3) for i in whole)
    for _ in range(50):  # executors are told to delete them and nobody waits
        if not files() - left:
            break
        time.sleep(0.2)
    assert not files() - left


def test_warc_round_trip(spark, scratch):
    g = rng(12)
    big = prose(g, 9000)
    rows = [(1, "x", "u"), (2, "x", "u"), (3, big, "u"), (4, big, "u"), (5, None, "u"), (6, "", "u"), (7, "é\r\n0\r\n\r\n中", "u"), (None, "x", "u"), (8, prose(g, 20000), "u"), (9, "last", "u"), (9, "last", "u")]
    pages = spark.createDataFrame(rows, "page_id long, html string, payload string")
    found = warc.round_trip(pages, scratch, segment_bytes=1000, file_bytes=4000).collect()
    best = {}
    for i, h, _ in rows:
        if i is not None:
            best[h or ""] = max(best.get(h or "", i), i)
    expected = []
    for i, h, _ in rows:
        raw = (h or "").encode()
        revisit = best[h or ""] != i
        expected.append((i, len(raw), warc.base32_sha1(hashlib.sha1(raw).digest()), "revisit" if revisit else "response", best[h or ""] if revisit else None, None if revisit else raw))
    assert sorted(map(str, expected)) == sorted(str((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, None if r.payload is None else bytes(r.payload))) for r in found)


def test_warc_damage_is_found(spark, tmp_path):
    raw = b"p" * 5000
    parts = list(warc.page_records(1, raw, hashlib.sha1(raw).digest(), None, "0-1", 1000))
    (tmp_path / "a.warc.gz").write_bytes(b"".join(parts[:2] + parts[3:]))
    with pytest.raises(Exception, match="missing or do not make"):
        warc.read(spark.read.format("binaryFile").load(str(tmp_path))).collect()
    assert warc.dechunked(warc.chunked(raw, 7)) == raw
    with pytest.raises(ValueError):
        list(warc.records(parts[0][:-20]))


def test_warc_without_pages(spark, scratch):
    assert warc.round_trip(spark.createDataFrame([], "page_id long, html string"), scratch).count() == 0


URLS = [None, "", "no scheme", "http://com/en/x", "HTTP://WWW.Example.COM/en/71?x=1", "http://example.com/en/8", "http://xexample.com/en/7", "http://a.net/de/1", "http://a.example.net/de/81#f", "http://net", "ftp://org/es/?q", "http://org/es", "x://http://com/en/", "http://com:80/en/", "http://com./en/", "http://de.com/en/7"]
RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]


def judge(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([len(rest), *(rest.index(c) for c in "/?#" if c in rest)])
    host, path = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut]), rest[cut:].split("#")[0].split("?")[0]
    fits = [(len(h + p), h + p, v) for h, p, v in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, None, "allow"))
    return host, path, best[1], best[2]


def test_url_rules(spark):
    pages = spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string")
    found = url_filter.UrlFilter(spark, pages, [url_filter.Rule(*r) for r in RULES]).judge(pages, "page_id").collect()
    assert {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in found} == {i: judge(u) for i, u in enumerate(URLS)}


def test_cascade_is_exact_over_its_universe(spark):
    universe = spark.range(6000).selectExpr("cast(id as string) as key")
    listed = [str(i) for i in range(0, 6000, 7)] + ["elsewhere"]
    cascade = url_filter.build(spark, listed, universe)
    assert len(cascade.levels) > 2
    wrong = universe.where(cascade.has(universe["key"]) != (universe["key"].cast("long") % 7 == 0)).count()
    assert wrong == 0


def test_url_filter_without_rules_or_pages(spark):
    none = spark.createDataFrame([], "page_id long, url string")
    rules = [url_filter.Rule(*r) for r in RULES]
    assert url_filter.UrlFilter(spark, none, rules).judge(none, "page_id").count() == 0
    some = spark.createDataFrame([(1, "http://com/en/")], "page_id long, url string")
    assert url_filter.UrlFilter(spark, some, []).judge(some, "page_id").first().verdict == "allow"


@pytest.mark.parametrize("name", ["op2_line_dedup", "op3_near_dedup", "op4_warc", "op6_decontamination", "op9_exact_dedup", "op10_url_filter"])
def test_queries_equal_sql(spark, same_rows, name):
    from logbrook.llm import queries

    same_rows(queries.QUERIES[name](spark, DATA), queries.ORACLE[name])
