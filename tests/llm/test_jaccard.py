import random

import numpy as np
import pyarrow as pa
import pytest
from fixtures import documents, empty, shingle_set

from plumbline.llm import jaccard


def brute(rows):
    sets = [shingle_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                parent[find(i)] = find(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        r = find(i)
        if doc_id is not None:
            least[r] = min(least.get(r, doc_id), doc_id)
    return sorted(((-1 if d is None else d), len(s), -1 if (c := least.get(find(i))) is None else c) for i, ((d, _), s) in enumerate(zip(rows, sets)))


def run(df):
    return sorted(((-1 if r.doc_id is None else r.doc_id), r.n_shingles, -1 if r.component_id is None else r.component_id) for r in jaccard.near_duplicates(df).collect())


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
    return " ".join(words)


@pytest.mark.parametrize("short", [9, 2])
def test_random_documents(spark, monkeypatch, short):
    """Groups of near copies, chains at the threshold and passages that many documents share; with few and many long columns."""
    monkeypatch.setattr(jaccard, "SHORT", short)
    monkeypatch.setattr(jaccard, "HUBS", 8 if short == 9 else 1)
    monkeypatch.setattr(jaccard, "BLOCK", 8 if short == 2 else 128)
    rng = random.Random(short)
    vocabulary = [f"w{i}" for i in range(300)]
    rows = []
    for _ in range(6):
        base = [rng.choice(vocabulary) for _ in range(rng.randrange(30, 120))]
        rows += [edited(rng, base, rng.randrange(0, 4)) for _ in range(rng.randrange(2, 25))]
    shared = " ".join(rng.choice(vocabulary) for _ in range(60))
    rows += [shared + " " + " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(3, 30))) for _ in range(60)]
    rows += [" ".join(["a"] * n) for n in range(1, 9)] + ["", None, "b c", "B  c"]
    rows = list(enumerate(rows))
    assert run(documents(spark, [(i, t, None, None) for i, t in rows])) == brute(rows)


def test_edges(spark):
    df = documents(spark, extra=True)
    rows = [(r.doc_id, r.text) for r in df.collect()]
    got = jaccard.near_duplicates(df)
    assert run(df) == brute(rows)
    assert all(r.first for r in got.where("n_shingles = 0").collect())
    assert jaccard.near_duplicates(empty(spark)).count() == 0


def test_a_copy_without_an_id_leaves_the_component_its_id(spark):
    text = "one two three four five six seven"
    got = jaccard.near_duplicates(documents(spark, [(None, text, "en", "a"), (5, text, "en", "a"), (7, text, "en", "a")])).collect()
    assert {(r.doc_id, r.component_id, r["first"]) for r in got} == {(None, 5, False), (5, 5, True), (7, 5, False)}


def test_sketches_never_show_more_than_the_difference():
    rng = np.random.default_rng(4)
    for n, m, common in ((5, 9, 3), (200, 230, 190), (3000, 2500, 2400), (40_000, 100, 90), (0, 7, 0)):
        pool = np.unique(rng.integers(0, 2**63, n + m, dtype=np.uint64))
        a, b = pool[:n], pool[n - common : n - common + m]
        x, y = jaccard.sketch(a), jaccard.sketch(b)
        words = min(len(x), len(y))
        differ = int(np.bitwise_count(jaccard.folded(x, words) ^ jaccard.folded(y, words)).sum())
        apart = len(np.setxor1d(a, b))
        assert differ <= apart and (apart > 2000 or differ > apart * 0.6)


def test_copies_of_one_text_that_are_not_linked_with_each_other_write_few_pairs():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 170, dtype=np.uint64)
    sets = [np.unique(np.concatenate([base[rng.permutation(170)[:155]], rng.integers(0, 2**63, 15, dtype=np.uint64)])) for _ in range(120)]
    entries = [{"id": i, "n": len(s), "place": 0, "label": i, "sketch": jaccard.sketch(s).tobytes()} for i, s in enumerate(sets)]
    kind = pa.list_(pa.struct([("id", pa.int64()), ("n", pa.int64()), ("place", pa.int64()), ("label", pa.int64()), ("sketch", pa.binary())]))
    batch = pa.RecordBatch.from_arrays([pa.array([entries], kind), pa.array([entries], kind)], names=["own", "other"])
    found = {(a, b) for out in jaccard._between([batch]) for a, b in zip(out.column(0).to_pylist(), out.column(1).to_pylist())}
    linked = {(i, j) for i in range(120) for j in range(i + 1, 120) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 80 * len(np.union1d(sets[i], sets[j]))}
    assert linked <= found and len(found) < 0.2 * 120 * 119 / 2
