from collections import Counter
from fractions import Fraction
from math import gcd

import pytest
from fixtures import documents, empty
from hypothesis import given, settings
from hypothesis import strategies as st

from plumbline.llm import mixing, queries


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 12), min_size=1, max_size=6))
def test_a_period_keeps_every_source_within_one_block(units):
    weights = {f"s{i}": u for i, u in enumerate(units)}
    total, had = sum(units), Counter()
    for t, s in enumerate(mixing.pattern(weights)):
        had[s] += 1
        assert all(abs(had[x] * total - weights[x] * (t + 1)) < total for x in weights)
    assert had == Counter(weights)


def test_phases_take_every_block_once():
    blocks, weights = {"a": 7, "b": 30, "c": 1}, {"a": 2, "b": 3, "c": 5, "d": 1}
    taken = Counter()
    for _, units, _ in mixing.phases(blocks, weights):
        assert "d" not in units
    plan = mixing.phases(blocks, weights)
    for k, (slot, units, had) in enumerate(plan):
        for s in units:
            taken[s] += (plan[k + 1][2].get(s, blocks[s]) if k + 1 < len(plan) else blocks[s]) - had[s]
    assert taken == Counter(blocks)


def test_documents(spark):
    rows = [(i, f"t{i}", None, "abc"[i % 3] if i % 7 else None) for i in range(500)]
    got = mixing.mixed(documents(spark, rows), {"a": 3, "b": 1}, 4, 2).collect()
    assert len(got) == 500 and len({(r.slot, r.place) for r in got}) == 500
    kinds = {}
    for r in got:
        kind = r.source if r.source in ("a", "b") else "other"
        assert kinds.setdefault(r.slot, kind) == kind
    for kind in ("a", "b", "other"):
        own = [r.doc_id for r in sorted(got, key=lambda r: (r.slot, r.place)) if kinds[r.slot] == kind]
        assert own == sorted(own)
    last = min(max(t for t, k in kinds.items() if k == kind) for kind in ("a", "b", "other"))
    had, weights = Counter(), {"a": 3, "b": 1, "other": 2}
    for t in range(last):
        had[kinds[t]] += 1
        assert all(abs(had[k] - (t + 1) * w / 6) < 1 for k, w in weights.items())


def test_edges(spark):
    docs = documents(spark, extra=True)
    got = mixing.mixed(docs, {"a": 1}, 2, 1)
    assert got.count() == docs.count() and set(got.columns) == set(docs.columns)
    assert mixing.mixed(empty(spark), {"a": 1}, 2, 1).count() == 0
    with pytest.raises(ValueError):
        mixing.mixed(docs, {"a": 0}, 2, 1)


def test_every_source_has_its_own_deadlines(spark):
    rows = [(i, f"t{i}", None, "a" if i % 2 else "hot" if i < 300 else ("c", "d", None)[i % 3]) for i in range(900)]
    got = mixing.mixed(documents(spark, rows), {"a": 3}, 2, mixing.Divided(4)).collect()
    assert len(got) == 900 and len({(r.slot, r.place) for r in got}) == 900
    kinds = {r.slot: r.source for r in got}
    assert all(kinds[r.slot] == r.source for r in got)
    weights = {"a": 3, "hot": 1, "c": 1, "d": 1, None: 1}
    had, last = Counter(), min(max(t for t, k in kinds.items() if k == kind) for kind in weights)
    assert last > 300
    for t in range(last):
        had[kinds[t]] += 1
        assert all(abs(had[k] - (t + 1) * w / 7) < 1 for k, w in weights.items())


def test_weights_of_the_given_sources(spark):
    got = queries.op6_pfair_mixing(spark, "/root/testdata/sf0.01").collect()
    blocks = Counter(r.source for r in {(r.slot, r.source): r for r in got}.values())
    assert len(blocks) > len(queries.SOURCE_UNITS)
    rest = [s for s in blocks if s not in queries.SOURCE_UNITS]
    share = {s: queries.SOURCE_UNITS[s] / 100 if s in queries.SOURCE_UNITS else queries.OTHER_UNITS / 100 / len(rest) for s in blocks}
    kinds = {r.slot: r.source for r in got}
    last = min(max(t for t, k in kinds.items() if k == s) for s in blocks)
    had = Counter()
    for t in range(last):
        had[kinds[t]] += 1
        assert all(abs(had[s] - (t + 1) * w) < 1 for s, w in share.items())


def test_any_number_of_sources(spark):
    rows = [(i, f"t{i}", None, "a" if i % 3 == 0 else f"s{i % 1100}") for i in range(6600)]
    got = mixing.mixed(documents(spark, rows), {"a": 3}, 2, mixing.Divided(4)).collect()
    assert len(got) == 6600 and len({(r.slot, r.place) for r in got}) == 6600
    kinds = {r.slot: r.source for r in got}
    assert all(kinds[r.slot] == r.source for r in got)
    rest = {r.source for r in got} - {"a"}
    weights = {"a": 3 / 7} | {s: 4 / 7 / len(rest) for s in rest}
    last = min(max(t for t, k in kinds.items() if k == s) for s in weights)
    assert last > len(rest) > 1000
    had = Counter()
    for t in range(last):
        had[kinds[t]] += 1
        if t % 50 == 0:
            assert all(abs(had[s] - (t + 1) * w) < 1 for s, w in weights.items())
    many = spark.range(100_000).selectExpr("id AS doc_id", "concat('crawl', id) AS source")
    got = mixing.mixed(many, {"a": 1}, 16, mixing.Divided(1)).selectExpr("max(slot) AS last", "count(DISTINCT slot) AS n").first()
    assert (got.last, got.n) == (99_999, 100_000)


def slots_by_earliest_deadline(blocks, weights):
    """A plain schedule: in every slot the released block with the earliest deadline, phase by phase, from fractions."""
    left, out = dict(blocks), []
    while any(left.values()):
        active = {s: weights[s] for s in weights if left.get(s)}
        done, total, t = dict.fromkeys(active, 0), sum(active.values()), 0
        short = False
        while not short or t % period:
            period = total // gcd(*active.values())
            released = [s for s in active if Fraction(done[s] * total, active[s]).__floor__() <= t]
            s = min(released, key=lambda s: (Fraction((done[s] + 1) * total, active[s]).__ceil__(), s))
            done[s] += 1
            out.append(s if done[s] <= left[s] else None)  # a slot of a source that has run out stays empty
            t += 1
            short = any(done[x] >= left[x] for x in active)
        for s in active:
            left[s] = max(left[s] - done[s], 0)
    return out


def test_against_a_plain_schedule(spark):
    rows = [(i, f"t{i}", None, "aaaaabbbc"[i % 9]) for i in range(360)]
    got = mixing.mixed(documents(spark, rows), {"a": 2, "b": 3}, 4, 1).collect()
    want = slots_by_earliest_deadline({"a": 50, "b": 30, mixing.OTHER: 10}, {"a": 2, "b": 3, mixing.OTHER: 1})
    kinds = {r.slot: r.source if r.source in "ab" else mixing.OTHER for r in got}
    assert kinds == {t: s for t, s in enumerate(want) if s is not None}


def test_scratch_tables_are_written_small(spark):
    from plumbline.llm.shared import written

    (file, *_) = written(spark.range(10).selectExpr("id", "repeat('a text of its own ', 9) AS text"), "small").inputFiles()
    assert file.endswith(".zstd.parquet")
