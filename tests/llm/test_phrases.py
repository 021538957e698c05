import random
import re
from collections import Counter

import numpy as np
import pytest
from compare import connect, difference
from fixtures import documents, empty

from plumbline.llm import phrases, queries
from plumbline.llm.phrases import Automaton, Shard, united


def grams(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    for piece in re.split("[.,;:!?\n-\r]", text):
        w = [x for x in re.split("[ \t]", piece) if x]
        for n in range(1, 5):
            for i in range(len(w) - n + 1):
                yield tuple(x.encode() for x in w[i : i + n])


def brute(rows, least, top):
    """(lang, rank, phrase, a, l, r, n, score) from plain dictionaries."""
    f, out = {}, []
    for _, text, lang, _ in rows:
        f.setdefault(lang if lang is not None else "und", Counter()).update(grams(text))
    for lang, c in f.items():
        n = sum(v for k, v in c.items() if len(k) == 1)
        candidates = {k: v for k, v in c.items() if len(k) > 1 and v >= least}
        gone = {k[i:j] for k, v in candidates.items() for i in range(len(k)) for j in range(i + 2, len(k) + 1) if j - i < len(k) and 100 * v >= 80 * c[k[i:j]]}
        found = []
        for k, a in candidates.items():
            if k not in gone:
                score, at = min((2_000_000 * a // (c[k[:i]] + c[k[i:]]), i) for i in range(1, len(k)))
                found.append((-score, -a, b" ".join(k), c[k[:at]], c[k[at:]]))
        out += [(lang, i + 1, p.decode(), -a, left, right, n, -s) for i, (s, a, p, left, right) in enumerate(sorted(found)[:top])]
    return sorted(out)


def run(df, least, top, **how):
    return sorted(tuple(r) for r in phrases.collocations(df, least, top, **how).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def made(seed, docs, words):
    rng = random.Random(seed)
    vocabulary = ["the", "of", "and", "New", "york", "é", "naïve", "🙂", "a\0b", "x-y", "city", "in", "it's"]
    join = lambda: rng.choice([" ", " ", " ", " ", "  ", "\t", ", ", ".\n", " ", "! "])
    return [(i, "".join(rng.choice(vocabulary[: rng.randrange(2, 14)]) + join() for _ in range(rng.randrange(words))), rng.choice(["en", "de", None, "und"]), None) for i in range(docs)]


@pytest.mark.parametrize("shard, step, ranges", [(1 << 20, 1 << 22, 5), (50, 64, 3), (7, 16, 1)])
def test_random_texts(spark, monkeypatch, shard, step, ranges):
    monkeypatch.setattr(phrases, "SHARD", shard)
    monkeypatch.setattr(phrases, "STEP", step)
    rows = made(shard, 60, 150) + [(100, "new york city " * 400, "en", None), (101, None, "en", None), (102, "", None, None), (103, " .,; \t", "xx", None)]
    df = documents(spark, rows).repartition(3)
    # a shard's bound is read in the worker, so it is given by hand as well
    for least, top in ((3, 2000), (2, 5), (1, None)):
        assert run(df, least, top, ranges=ranges) == brute(rows, least, top)


@pytest.mark.parametrize("size, step", [(40, 30), (5, 8), (1000, 1 << 22)])
def test_shards_end_anywhere(monkeypatch, size, step):
    monkeypatch.setattr(phrases, "STEP", step)
    rows = made(size, 20, 200)
    got = {}
    shard = Shard(4, size)
    parts = [o for _, text, lang, _ in rows for o in shard.add(lang or "und", text.encode())] + list(shard.flush())
    by_range = {}
    for lang, r, automaton in parts:
        by_range.setdefault((lang, r), []).append(Automaton.unpacked(automaton.packed()))
    for (lang, r), automata in by_range.items():
        total = united(automata)
        assert total.words == sorted(total.words)
        for labels, weights in total.grams(1):
            for g, w in zip(labels.tolist(), weights.tolist()):
                words = tuple(total.words[i] for i in g)
                assert phrases.range_of(lang, words, 4) == r and (lang, words) not in got
                got[lang, words] = w
    want = Counter((lang or "und", g) for _, text, lang, _ in rows for g in grams(text))
    assert got == dict(want)


def test_automata():
    words = [b"a", b"b", b"c"]
    rows = np.array([[0, -1, -1, -1], [0, 1, -1, -1], [0, 1, 2, 2], [2, 2, 2, 2]])
    one = Automaton.built(words, rows, np.array([5, 3, 2, 1 << 40]))
    assert [len(level[1]) for level in one.levels] == [2, 2, 2, 2]  # prefixes are shared
    assert [[(g.tolist(), w.tolist())] for g, w in one.grams(1)][3] == [([[0, 1, 2, 2], [2, 2, 2, 2]], [2, 1 << 40])]
    both = united([one, Automaton.built([b"b", b"z"], np.array([[0, -1, -1, -1], [1, 0, -1, -1]]), np.array([7, 8])), one])
    assert both.words == [b"a", b"b", b"c", b"z"] and [w.tolist() for _, w in both.grams(1)] == [[10, 7], [6, 8], [], [4, 1 << 41]]
    asked = Automaton.built([b"a", b"b", b"q"], np.array([[0, 1, -1, -1], [1, -1, -1, -1], [2, -1, -1, -1]]), np.ones(3, np.int64))
    assert [w.tolist() for w in both.composed(asked)] == [[10, 7, 0], [6], [], []]
    assert [w.tolist() for _, w in both.pruned(8).grams(1)] == [[10], [8], [], [1 << 41]]
    none = Automaton.unpacked(one.pruned(1 << 50).packed())
    assert len(none) == 0 and none.words == [] and [w.tolist() for w in none.composed(asked)] == [[0, 0, 0], [0], [], []]


def test_scores_past_64_bits(spark):
    df = spark.createDataFrame([(4 * 10**14, 5 * 10**14, 9 * 10**18)], "a long, l long, r long")
    assert df.selectExpr("(CAST(a AS DECIMAL(20, 0)) * 2000000) DIV (CAST(l AS DECIMAL(20, 0)) + r) AS s").first().s == 2_000_000 * 4 * 10**14 // (5 * 10**14 + 9 * 10**18)


def test_sql(spark):
    sf_dir = "/root/testdata/sf0.001"
    df = queries.QUERIES["op13_phrase_collocations"](spark, sf_dir)
    assert difference(df, connect(sf_dir), queries.ORACLES["op13_phrase_collocations"]) is None
    assert df.count() > 10


def test_edges(spark):
    rows = [(1, None, None, None)] * 3
    assert run(documents(spark, rows, extra=True), 1, 5) == [] and run(empty(spark), 1, 5) == []
    rows = [(1, "one two", None, None), (1, "one two", "und", None), (None, "ONE two three", None, None)]
    assert run(documents(spark, rows, extra=True), 2, 5) == brute(rows, 2, 5) == [("und", 1, "one two", 2, 3, 2, 6, 800000)]
    long = [(1, "w" * 5_000_000 + " end end", "en", None)] * 2
    assert run(documents(spark, long), 2, 5) == brute(long, 2, 5)


def test_workers_get_few_rows_at_once(spark, monkeypatch):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    for name in ("_shards", "_unions"):
        def small(how, batches, inner=getattr(phrases, name), most=phrases.BATCH):
            def checked():
                for b in batches:
                    assert b.num_rows <= most
                    yield b

            return inner(how, checked())

        monkeypatch.setattr(phrases, name, small)
    rows = made(1, 300, 60)
    assert run(documents(spark, rows).coalesce(1), 3, 50, ranges=300) == brute(rows, 3, 50)
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before


def test_workers_give_memory_back(monkeypatch):
    ended = []
    monkeypatch.setattr(phrases, "given_back", lambda batches: (*batches, ended.append(1)), raising=False)
    assert list(phrases._shards(4, iter(()))) + list(phrases._unions(2, iter(()))) == [None, None] and len(ended) == 2
