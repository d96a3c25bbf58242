import numpy as np
import pyarrow as pa
from brute import alnum, words
from hypothesis import given, settings
from hypothesis import strategies as st

from logbrook.llm import decontaminate as D
from logbrook.llm import kernels as K
from logbrook.llm import substring_dedup as S

TEXT = st.text(alphabet="aB zé\n\t .中", max_size=40)


def cut(texts, inside):
    out = []
    for _, _, data, offsets in K.slices(pa.array(texts, pa.string()), 16):
        t = K.tokenize(data, offsets, inside)
        for a, b in zip(t.bounds[:-1], t.bounds[1:]):
            out.append([(t.data[x:y].tobytes().decode(), int(h)) for x, y, h in zip(t.starts[a:b], t.ends[a:b], t.hashes[a:b])])
    return out


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), TEXT), max_size=6))
def test_words_equal_regular_expressions(texts):
    seen = {}
    for inside, plain in ((K.NOT_SPACE, words), (K.ALNUM, alnum)):
        found = cut(texts, inside)
        assert [[w for w, _ in d] for d in found] == [plain(t) for t in texts]
        for d in found:
            for w, h in d:
                assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=40), st.integers(1, 12))
def test_suffix_array_is_sorted(text, depth):
    text = np.array(text, np.int64)
    order = D.suffix_array(text, depth).tolist()
    assert sorted(order) == list(range(len(text)))
    keys = [(text[i : i + depth].tolist() + [0] * depth)[:depth] for i in order]
    assert keys == sorted(keys)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 40), st.integers(0, 5), st.integers(0, 40), st.integers(1, 9)), min_size=1, max_size=9))
def test_chains_are_as_good_as_any(raw):
    runs = [(s, s + n, a, w) for s, n, a, w in raw]

    def best(j, cost=S.GAP_COST):
        s, _, a, w = runs[j]
        gains = [0.0]
        for i, (s2, l2, a2, _) in enumerate(runs):
            if l2 < s and a2 + l2 - s2 < a:
                gains.append(best(i) - cost * ((s - l2) + (a - (a2 + l2 - s2))))
        return w + max(gains)

    first = S.chain(runs)[0]
    total = runs[first[0]][3]
    for i, j in zip(first, first[1:]):
        (s1, l1, a1, _), (s2, _, a2, w2) = runs[i], runs[j]
        assert l1 < s2 and a1 + l1 - s1 < a2
        total += w2 - S.GAP_COST * ((s2 - l1) + (a2 - (a1 + l1 - s1)))
    assert abs(total - max(best(j) for j in range(len(runs)))) < 1e-9
    assert sorted(x for c in S.chain(runs) for x in c) == list(range(len(runs)))
