import hashlib
import re
from collections import Counter

import numpy as np
import pytest
from brute import components, mutate, prose, rng, words
from pyspark.sql import functions as F

from logbrook.llm import components as C
from logbrook.llm import exact_dedup, line_dedup, near_dedup, substring_dedup


def test_components(spark, scratch):
    links = [(i, i + 1) for i in range(0, 20)] + [(40, 30), (30, 35), (50, 50), (7, 3)]
    found = {r.id: r.component for r in C.components(spark.createDataFrame(links, "a long, b long"), scratch).collect()}
    assert found == {**{i: 0 for i in range(21)}, 30: 30, 35: 30, 40: 30}
    assert C.components(spark.createDataFrame([], "a long, b long"), scratch, "none").count() == 0


@pytest.mark.parametrize("one_task", (0, 40, 10**6))
def test_components_in_rounds_and_in_one_task(spark, scratch, monkeypatch, one_task):
    monkeypatch.setattr(C, "ONE_TASK", one_task)
    written, write = [], scratch.write
    monkeypatch.setattr(scratch, "write", lambda df, name: (written.append(name), write(df, name))[1])
    g = rng(31)
    links = [(g.randrange(90), g.randrange(90)) for _ in range(50)] + [(200 - i, 199 - i) for i in range(30)]
    up = list(range(201))
    for _ in up:
        for a, b in links:
            up[a] = up[b] = min(up[a], up[b])
    found = {r.id: r.component for r in C.components(spark.createDataFrame(links, "a long, b long"), scratch).collect()}
    assert found == {i: up[i] for link in links if link[0] != link[1] for i in link}
    assert (len(written) == 1) == (one_task == 10**6)  # few links cost one table, not one for every jump


def test_many_sets_are_compared_as_pairs_are():
    g = np.random.default_rng(4)
    base = g.choice(1 << 60, 100, replace=False).astype(np.uint64)
    sets = [np.unique(np.concatenate([g.choice(base, k, replace=False), g.integers(0, 1 << 60, 100 - k).astype(np.uint64)])) for k in (100, 93, 92, 86, 85, 84, 60, 100)]
    names, flat = np.unique(np.concatenate(sets), return_inverse=True)
    ends, flags = np.cumsum([len(x) for x in sets]), np.zeros(len(names), bool)
    for i, one in enumerate(sets):
        which = np.array([j for j in range(len(sets)) if j != i])
        found = near_dedup.shares_many(flat[ends[i] - len(one) : ends[i]], ends, flat, which, flags, 0.75)
        assert found.tolist() == [near_dedup.shares(one, sets[j], 0.75) for j in which]
        assert not flags.any()


def test_near_dedup_of_few_rows_writes_few_files(spark, docs, scratch):
    g, before = rng(32), spark.conf.get("spark.sql.shuffle.partitions")
    rows = [(i, prose(g, 40)) for i in range(300)]
    spark.conf.set("spark.sql.shuffle.partitions", "97")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    files, write = {}, scratch.write
    scratch.write = lambda df, name: files.setdefault(name, write(df, name))
    try:
        near_dedup.near_components(docs(rows), scratch)
        assert files["found"].count() == 300 and len(files["found"].inputFiles()) <= 4 * 4
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def near(docs, scratch, rows):
    return {r.id: (r.n_shingles, r.component) for r in near_dedup.near_components(docs(rows), scratch).collect()}


def test_near_dedup_equals_brute_force(docs, scratch):
    g = rng()
    rows, i = [], 0
    for _ in range(25):
        base = prose(g, g.choice([3, 8, 60, 200]))
        for rate in (0, 0, 0.02, 0.04, 0.06, 0.3):
            rows.append((i, mutate(g, base, rate)))
            i += 1
    rows += [(900, None), (901, ""), (902, " \n"), (903, "A b C d"), (904, "a  B c\nd")]
    expected = components(rows)
    found = near(docs, scratch, rows)
    assert {k: v[1] for k, v in found.items()} == expected
    assert found[903] == (1, 903) and found[904] == (1, 903) and found[900] == (0, 900)


def test_near_dedup_with_a_large_group(docs, scratch, monkeypatch):
    monkeypatch.setattr(near_dedup, "LEAF", 8)
    g = rng(2)
    base = prose(g, 120, 5000)
    rows = [(i, mutate(g, base, 0.01)) for i in range(70)] + [(200 + i, prose(g, 60, 5000) + " " + base[:150]) for i in range(40)]
    assert {k: v[1] for k, v in near(docs, scratch, rows).items()} == components(rows)


def family(g, n, edits, pairs, more):
    """n texts of one template, `edits` words changed in each, and partners of the first ones with `more` words changed."""
    base = prose(g, 1000, 10**6).split()

    def edited(text, k):
        text = list(text)
        for slot in g.sample(range(199), k):
            text[5 * slot + 2] = f"e{g.randrange(10**9)}"
        return text

    texts = [edited(base, edits) for _ in range(n)]
    texts += [edited(texts[i], more) for i in range(pairs)]
    return [(i, " ".join(t)) for i, t in enumerate(texts)]


def test_near_dedup_large_nodes_at_the_last_level(docs, scratch, monkeypatch):
    monkeypatch.setattr(near_dedup, "LEAF", 8)
    monkeypatch.setattr(near_dedup, "DEPTH", 3)
    rows = family(rng(21), 160, 19, 24, 25)
    expected = components(rows)
    assert len(set(expected.values())) > 100
    assert {k: v[1] for k, v in near(docs, scratch, rows).items()} == expected


def test_near_dedup_labels_are_joined_once_a_round(docs, scratch, monkeypatch):
    for name, value in (("LEAF", 8), ("BLOCK", 2), ("DEPTH", 1), ("TREES", 3)):
        monkeypatch.setattr(near_dedup, name, value)
    plans, write = {}, scratch.write

    def watched(df, name, *more):
        plans[name] = df._jdf.queryExecution().optimizedPlan().toString()
        return write(df, name, *more)

    monkeypatch.setattr(scratch, "write", watched)
    near(docs, scratch, family(rng(6), 40, 21, 0, 0))
    assert plans["rest-level-0"].count("LeftOuter") == 1
    assert "LeftOuter" not in plans["rest-grown-0"]  # the signatures of members and pivots come without the labels


def test_near_dedup_odd_tables(spark, docs, scratch):
    assert near(docs, scratch, []) == {}
    text = "one two three four five six"
    found = near_dedup.near_components(docs([(5, text), (5, text), (None, text), (7, text)]), scratch).collect()
    assert sorted((r.id or -1, r.component or -1) for r in found) == [(-1, -1), (5, 5), (5, 5), (7, 5)]


def judged(docs, scratch, index, rows, batch="0", name="rows"):
    found = exact_dedup.exact_dedup(docs(rows), index, lambda x: scratch.write(x, f"{name}-{batch}"), batch)
    return {r.id: (r.keep_id, r.copies, r.kept) for r in found.collect()}


def test_exact_dedup_and_later_batches(spark, docs, scratch):
    index = exact_dedup.DigestIndex(spark, f"{scratch.path}/index", buckets=4)
    rows = [(1, "a b"), (2, "ab "), (3, "a  b"), (4, None), (5, ""), (6, "\n"), (7, "c"), (8, "ab ")]
    first = judged(docs, scratch, index, rows)
    assert first == {1: (3, 3, False), 2: (3, 3, False), 3: (3, 3, True), 4: (6, 3, False), 5: (6, 3, False), 6: (6, 3, True), 7: (7, 1, True), 8: (8, 1, True)}
    second = judged(docs, scratch, index, [(20, "a b          "), (21, "new")], "1")
    assert second == {20: (3, 3, False), 21: (21, 1, True)}
    assert judged(docs, scratch, index, [(20, "a b          "), (21, "new")], "1") == second  # again: nothing is added
    assert index.table().count() == 5


def test_exact_dedup_reopened_hot_and_empty(spark, docs, scratch, tmp_path):
    path = f"file://{tmp_path}/index"
    rows = [(i, "same") for i in range(400)] + [(1000 + i, f"t{i // 2}") for i in range(600)]
    made = judged(docs, scratch, exact_dedup.DigestIndex(spark, path, "ix_one", 4), rows)
    assert made[399] == (0, 400, False) and made[1001] == (1000, 2, False)
    spark.sql("DROP TABLE ix_one")
    again = exact_dedup.DigestIndex(spark, path, "ix_two", 4)
    assert judged(docs, scratch, again, [(7777, "sa me")], "2") == {7777: (0, 400, False)}
    assert judged(docs, scratch, exact_dedup.DigestIndex(spark, f"file://{tmp_path}/none", buckets=2), [], "e") == {}


def test_exact_dedup_meets_the_index_in_an_anti_join(spark, docs, scratch):
    index = exact_dedup.DigestIndex(spark, f"{scratch.path}/plan", buckets=4)
    rows = [(-(1 << 63), "ab"), (None, "a b"), (None, "a  b"), (3, "a b"), (4, "x " * 30000), (5, "x" * 30000), (-(1 << 63), "a\tb")]
    plan = index.new(exact_dedup.digests(docs(rows)))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "LeftAnti" in plan and "Python" not in plan and "Arrow" not in plan
    found = exact_dedup.exact_dedup(docs(rows), index, lambda x: scratch.write(x, "plan-rows")).collect()
    assert Counter((r.id, r.keep_id, r.copies, r.kept) for r in found) == Counter([(-(1 << 63), None, 5, False)] * 2 + [(None, None, 5, False)] * 2 + [(3, None, 5, False), (4, 4, 2, True), (5, 4, 2, False)])
    longest = exact_dedup.exact_dedup(docs([(9, "q r"), (-(1 << 63), "q r"), (None, "q r")]), index, lambda x: scratch.write(x, "plan-more"), "1").collect()
    assert {(r.id, r.keep_id, r.kept) for r in longest} == {(9, -(1 << 63), False), (-(1 << 63), -(1 << 63), True), (None, -(1 << 63), False)}


def brute_lines(rows, min_sites, most_cut=None):
    strip = " \t\n\x0b\x0c\r"
    sites = {}
    for _, t, s in rows:
        for x in (t or "").split("\n"):
            if x.strip(strip):
                sites.setdefault(x.strip(strip), set()).add(s)
    bad = {x for x, s in sites.items() if len(s) >= min_sites}
    out = {}
    for i, t, _ in rows:
        lines = (t or "").split("\n")
        size = lambda xs: sum(len(x.strip(strip).encode()) for x in xs)
        cut = [x for x in lines if x.strip(strip) in bad]
        if cut and size(cut) < size(lines) and (most_cut is None or size(cut) <= most_cut * size(lines)):
            kept = [x for x in lines if x.strip(strip) not in bad]
            tail = "\n" if lines[-1].strip(strip) in bad and kept else ""
            out[i] = "\n".join(kept) + tail
        else:
            out[i] = t
    return out


@pytest.mark.parametrize("most", [4_000_000, 0])
def test_line_dedup_equals_brute_force(docs, scratch, most):
    g = rng(4)
    common = [f"common line {k}" for k in range(6)]
    rows = []
    for i in range(120):
        own = [prose(g, 6) for _ in range(g.randrange(1, 5))]
        lines = own + [f" {c}\t" for k, c in enumerate(common) if g.random() < 0.12 * k]
        g.shuffle(lines)
        rows.append((i, "\n".join([*lines, *([""] if i % 7 == 0 else [])]), None if i % 13 == 0 else f"s{i % 13}"))
    rows += [(500, None, "s1"), (501, "", "s1"), (502, "\n\n", None), (503, "common line 5", "s2"), (504, "é中\r\ncommon line 5\r\nlonger own line that stays here", "s3")]
    found = {r.doc_id: r.text for r in line_dedup.line_dedup(docs(rows), scratch, min_sites=8, broadcast_lines=most).collect()}
    assert found == brute_lines(rows, 8)
    spared = line_dedup.line_dedup(docs(rows), scratch, min_sites=8, broadcast_lines=most, most_cut=0.5)
    assert {r.doc_id: r.text for r in spared.collect()} == brute_lines(rows, 8, 0.5) != found


@pytest.mark.parametrize("most", [4_000_000, 0])
def test_line_dedup_with_clashing_columns_and_long_texts(spark, scratch, most):
    rows = [(i, f"own {i}\nshared line", f"s{i}", "mine", 7, "k", [1]) for i in range(12)]
    rows += [(50, "\n".join(f"line {k}" for k in range(60000)) + "\nshared line", "s1", "mine", 7, "k", [1])]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, __n_cut string, __n_lines int, __key string, __bad array<int>")
    out = line_dedup.line_dedup(df, scratch, broadcast_lines=most)
    assert out.columns == [*df.columns, "__n_lines_1", "__n_cut_1"]
    found = {r.doc_id: (r.text, r["__n_cut"], r["__n_cut_1"], r["__bad"]) for r in out.collect()}
    assert found[3] == ("own 3\n", "mine", 1, [1]) and found[50][2] == 1 and found[50][0].endswith("line 59999\n")


def test_line_dedup_keeps_columns_and_empty_tables(docs, scratch):
    out = line_dedup.line_dedup(docs([]), scratch)
    assert out.columns[:5] == ["doc_id", "text", "source", "id", "n"] and out.count() == 0


def test_passages(docs, scratch):
    g = rng(6)
    shared, fuzzy = prose(g, 80, 10**6), prose(g, 120, 10**6)
    rows = [(1, prose(g, 50, 10**6) + " " + shared + " " + prose(g, 40, 10**6)), (2, prose(g, 10, 10**6) + " " + shared), (3, "x " + fuzzy), (4, prose(g, 30, 10**6) + " " + mutate(g, fuzzy, 0.04)), (5, prose(g, 200, 10**6)), (6, shared[: len(shared) // 3]), (None, shared), (8, None), (9, ""), (2, "other text of the same id")]
    found = {(r.id, r.anchor): r for r in substring_dedup.passages(docs(rows), scratch).collect()}
    assert set(found) == {(2, 1), (4, 3)}
    exact = found[2, 1]
    assert (exact.start, exact.end, exact.anchor_start, exact.anchor_end, exact.matches) == (10, 90, 50, 130, 80)
    assert found[4, 3].end - found[4, 3].start >= 100
    assert substring_dedup.passages(docs([]), scratch).count() == 0


def test_passages_of_many_copies_stay_linear(docs, scratch):
    g = rng(7)
    shared = prose(g, 70, 10**6)
    rows = [(i, prose(g, 20, 10**6) + " " + shared) for i in range(60)]
    found = substring_dedup.passages(docs(rows), scratch).collect()
    assert sorted((r.id, r.anchor) for r in found) == [(i, 0) for i in range(1, 60)]


def covered(found):
    out = {}
    for r in found:
        out.setdefault(r.id, set()).update(range(r.start, r.end))
    return out


def brute_covered(rows, least=50):
    """Words of each document in an equal run of at least `least` words with an earlier document, all pairs."""
    lists, out = sorted((i, words(t)) for i, t in rows), {}
    for n, (i, mine) in enumerate(lists):
        for _, other in lists[:n]:
            for shift in range(-len(other) + 1, len(mine)):
                run = 0
                for p in range(max(0, shift), min(len(mine), len(other) + shift) + 1):
                    if p < min(len(mine), len(other) + shift) and mine[p] == other[p - shift]:
                        run += 1
                        continue
                    if run >= least:
                        out.setdefault(i, set()).update(range(p - run, p))
                    run = 0
    return out


def test_passages_equal_brute_force_with_fragments_in_other_documents(docs, scratch):
    g = rng(17)
    fresh = lambda n: prose(g, n, 10**6)
    shared = [fresh(n) for n in (200, 90, 60, 51, 130)]
    pieces = [(p.split(), k) for p in shared for k in (20, 23)]
    rows = []
    for words_, k in pieces:  # fragments, before and between the documents that hold the whole
        rows += [(len(rows) + 100 * (len(rows) % 2), fresh(15) + " " + " ".join(words_[at : at + k]) + " " + fresh(15)) for at in range(0, len(words_), k)]
    rows = [(n, t) for n, (_, t) in enumerate(rows)]
    for n, p in enumerate(shared):
        rows += [(10 + 1000 * n + 1000, fresh(20) + " " + p + " " + fresh(20)), (10 + 1000 * n + 1500, fresh(30) + " " + p + " " + fresh(5) + " " + p)]
    rows += [(9000, shared[0] + " " + shared[1]), (9001, shared[2] + " " + shared[0][:300] + " " + shared[3])]
    found = substring_dedup.passages(docs(rows), scratch).collect()
    assert covered(found) == brute_covered(rows)


def test_a_passage_is_whole_where_earlier_documents_hold_pieces(docs, scratch):
    g = rng(18)
    shared = prose(g, 200, 10**6).split()
    rows = [(k, prose(g, 20, 10**6) + " " + " ".join(shared[15 * k : 15 * k + 20])) for k in range(13)]
    rows += [(100, prose(g, 20, 10**6) + " " + " ".join(shared)), (101, prose(g, 20, 10**6) + " " + " ".join(shared))]
    found = [tuple(r) for r in substring_dedup.passages(docs(rows), scratch).collect()]
    assert found == [(101, 100, 20, 220, 20, 220, 200)]


def test_passages_over_many_partitions_and_long_and_repeated_texts(spark, docs, scratch, monkeypatch):
    g = rng(19)
    monkeypatch.setattr(substring_dedup, "TASK_ROWS", 40)
    monkeypatch.setattr(substring_dedup, "SHARED", 5)
    shared = prose(g, 120, 10**6)
    rows = [(i, prose(g, 25, 10**6) + " " + shared) for i in range(80)] + [(200, "again " * 3000), (201, "x " + "again " * 2500), (202, prose(g, 3000, 10**6) + " " + shared)]
    found = substring_dedup.passages(docs([*rows, rows[3]]), scratch).collect()
    assert covered(found) == brute_covered([r for r in rows if r[0] < 200]) | {201: set(range(1, 2501)), 202: set(range(3000, 3120))}


def test_common_scans_equal_plain_ones():
    rows = [(0, 0, 5, 1, 9), (0, 1, 5, 1, 9), (0, 2, 7, 2, 4), (0, 3, 7, 3, 1), (1, 0, 7, 4, 8), (1, 1, 7, 4, 8), (1, 2, 7, 4, 8), (1, 3, 7, 4, 8), (2, 0, 7, 6, 2), (2, 1, 7, 6, 2), (2, 2, 8, 1, 1), (2, 3, 8, 1, 1)]
    assert sorted(substring_dedup.across(rows)) == [(4, 2, 8, 4), (4, 3, 8, 1), (6, 2, 2, 4), (6, 4, 2, 8)]


def test_near_dedup_recall_with_large_groups(docs, scratch):
    g = rng(29)
    rows = []
    for k in range(6):
        base = prose(g, 150, 10**6)
        rows += [(1000 * k + i, mutate(g, base, g.choice([0.003, 0.01, 0.02]))) for i in range(90)]
    rows += [(20000 + i, prose(g, 120, 10**6)) for i in range(40)] + [(30000, prose(g, 30000, 10**6))]
    rows += [(30001, rows[-1][1] + " more")]
    expected = components(rows)
    found = {k: v[1] for k, v in near(docs, scratch, rows).items()}
    linked = [i for i in expected if expected[i] != i]
    recall = sum(found[i] == expected[i] for i in linked) / len(linked)
    print("recall", recall, len(linked))
    assert recall >= 0.99 and all(found[i] == i for i in expected if expected[i] == i and list(expected.values()).count(i) == 1)
