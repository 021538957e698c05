import random

from fixtures import documents, empty

from plumbline.llm import lines


def brute(rows, least):
    """Lines covered by the longest match of any place with an earlier one, if it has enough words."""
    seq = [(d, line) for d, (_, text) in enumerate(rows) if text is not None for line in text.split("\n")]
    gone, seen = [False] * len(seq), {}
    for a in range(len(seq)):
        best = 0
        for b in seen.get(seq[a][1], ()):
            k = 0
            while a + k < len(seq) and seq[a + k][0] == seq[a][0] and seq[b + k][0] == seq[b][0] and seq[a + k][1] == seq[b + k][1]:
                k += 1
            best = max(best, k)
        if best and sum(len(line.split()) for _, line in seq[a : a + best]) >= least:
            gone[a : a + best] = [True] * best
        seen.setdefault(seq[a][1], []).append(a)
    kept = [[] for _ in rows]
    for (d, line), g in zip(seq, gone):
        if not g:
            kept[d].append(line)
    return sorted((i if i is not None else -1, None if t is None else "\n".join(kept[d])) for d, (i, t) in enumerate(rows))


def run(df, least):
    return sorted((r.doc_id if r.doc_id is not None else -1, r.text) for r in lines.without_repeats(df, least).collect())


def test_random_documents(spark):
    rng = random.Random(3)
    rows = [(i, "\n".join(rng.choice(["a", "b", "c d", "e f g", "", "\tw x", " \t y\t z "]) for _ in range(rng.randrange(1, 30)))) for i in range(40)]
    rows += [(40, rows[3][1]), (41, rows[3][1] + "\nx\n" + rows[4][1]), (42, "\n".join(["a"] * 33)), (43, None), (44, "")]
    df = documents(spark, [(i, t, None, None) for i, t in rows])
    for least in (1, 4, 12):
        assert run(df, least) == brute(rows, least)


def test_edges(spark):
    df = documents(spark, extra=True)
    got = lines.without_repeats(df, 5)
    assert got.count() == df.count()
    kept = {}
    for r in got.collect():
        kept.setdefault(r.doc_id, []).append(r.text)
    assert sorted(kept[2]) == ["", ""] and kept[6] == [None] and kept[5] == [""]
    assert sorted(kept[None]) == ["", "a text without an id"]
    assert lines.without_repeats(empty(spark), 5).count() == 0


def test_no_python_on_the_main_path(spark):
    plan = lines.without_repeats(documents(spark), 5)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_rounds_grow_with_what_they_change(spark, monkeypatch):
    joins, rows = [], {}

    def recorded(df, label, folder=None, inner=lines.written):
        joins.extend(x for x in df._jdf.queryExecution().executedPlan().toString().split("\n") if "HashJoin" in x and "_part" not in x)
        out = inner(df, label, folder)
        rows[folder.rpartition("/")[2]] = out.count()
        return out

    monkeypatch.setattr(lines, "written", recorded)
    long = "\n".join(f"line {i}" for i in range(16))
    texts = [(i, long if i < 2 else f"common\nown {i}\nalso common", None, None) for i in range(100)]
    got = lines.without_repeats(documents(spark, texts), 20)
    joins.extend(x for x in got._jdf.queryExecution().executedPlan().toString().split("\n") if "HashJoin" in x)
    # tables that grow with the corpus meet by one kind of join at every size
    assert joins == []
    # a round moves places that agree in so many lines or did before, not every line that occurs twice
    assert rows["rank0"] == 2 * 16 + 2 * 98 and rows["seen4"] == rows["rank4"] == 2 and rows["seen3"] < 30
    assert run(documents(spark, texts), 20) == brute([(i, t) for i, t, _, _ in texts], 20)
