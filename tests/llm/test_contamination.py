import random
import re

import pytest
from fixtures import documents, empty

from plumbline.llm import contamination

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(texts, items, window):
    owners = {}
    for item_id, text in items:
        w = words(text)
        n = min(window, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            owners.setdefault(tuple(w[i : i + n]), set()).add(str(item_id))
    out = []
    for text in texts:
        w, hit, found = words(text), set(), set()
        for n in {len(x) for x in owners}:
            for i in range(len(w) - n + 1):
                if own := owners.get(tuple(w[i : i + n])):
                    hit.update(range(i, i + n))
                    found |= own
        out.append((text, len(w), len(hit), sorted(found)))
    return sorted(out, key=str)


def run(df, items):
    rows = contamination.contamination(df, items, 4).collect()
    for r in rows:
        assert sum(r.contamination.spans[1::2]) - sum(r.contamination.spans[::2]) == r.contamination.n_hit
    return sorted(((r.text, r.contamination.n_words, r.contamination.n_hit, list(r.contamination["items"])) for r in rows), key=str)


@pytest.mark.parametrize("chunk", [1 << 20, 40])
def test_random_texts(spark, monkeypatch, chunk):
    monkeypatch.setattr(contamination, "CHUNK_BYTES", chunk)
    monkeypatch.setattr(contamination, "PAIRS", 3)
    rng = random.Random(5)
    text = lambda n: " ".join(rng.choice("aA bb. c-d é 9".split()) for _ in range(n))
    items = [(i, text(rng.randrange(0, 7))) for i in range(8)] + [(3, None), (None, "zz"), (10, "aa " * 5), (2, "aa " * 5)]
    rows = [(i, text(rng.randrange(0, 40)), None, None) for i in range(60)] + [(99, "aa " * 30, None, None), (98, None, None, None), (97, "zz", None, None)]
    want = brute([r[1] for r in rows], [x for x in items if x[0] is not None], 4)
    want = [(t, n, 1, o) if t == "zz" else (t, n, h, o) for t, n, h, o in want]  # an item without an id still marks its words
    assert run(documents(spark, rows, extra=True), spark.createDataFrame(items, "item_id long, text string")) == sorted(want, key=str)


def test_edges(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert {r.contamination.n_hit for r in contamination.contamination(documents(spark), none).collect()} == {0}
    assert contamination.contamination(empty(spark), spark.createDataFrame([(1, "a b")], "item_id long, text string")).count() == 0
