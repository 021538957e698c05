import hashlib
import random
import re
import zlib
from functools import lru_cache

import pytest
from pyspark.sql import types as T

from plumbline.llm import dialogues, queries

TURNS = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])
GRAMMAR = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
FULL = {"s": "system", "u": "user", "a": "assistant"}


def damage(rows):
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 0:
            yield conv, None
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        for _ in range(2 if kind == 3 else 1):
            yield conv, (turn, "user" if kind == 4 else role, text)


def brute_one(rows):
    """Least (cost, initials) from every row and state on, from the end."""
    faults, seen = [], set()
    for _, role, text in rows:
        body = re.sub(r"[\x20\x09-\x0D]+\Z", "", text)
        faults.append("blank" if not body else "duplicate" if (role, text) in seen else "" if body[-1] in ".!?" else "truncated")
        seen.add((role, text))

    @lru_cache(None)
    def rest(i, state, room):
        """(cost, initials, roles and texts) of the best end; ``room`` bounds the inserts in a row."""
        best = []
        if i == len(rows) and state in ("", "a"):
            best.append((0, "", ()))
        turn = "a" if state == "u" else "u"
        if room:
            cost, edits, turns = rest(i, turn, room - 1)
            best.append((cost + 3, "I" + edits, ((turn, None, ""), *turns)))
        if i < len(rows):
            _, role, text = rows[i]
            cost, edits, turns = rest(i + 1, state, 3)
            best.append((cost + 4, "D" + edits, turns))
            if faults[i] in ("", "truncated"):
                more = 3 * (faults[i] == "truncated")
                if (state, role[:1]) in GRAMMAR:
                    cost, edits, turns = rest(i + 1, role[0], 3)
                    best.append((cost + more, "K" + edits, ((role, 0, text), *turns)))
                cost, edits, turns = rest(i + 1, turn, 3)
                best.append((cost + 3 + more, "R" + edits, ((turn, None, text), *turns)))
        return min(best, key=lambda b: b[:2], default=(10**9, "", ()))

    for i in range(len(rows), -1, -1):
        for s in ("", "s", "u", "a"):
            rest(i, s, 3)
    cost, edits, turns = rest(0, "", 3)
    text = "\n".join(f"{r if named is not None else FULL[r]}:{t}" for r, named, t in turns)
    numbers = [t for t, *_ in rows if t is not None]
    gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    return gaps, *[faults.count(f) for f in ("blank", "duplicate", "truncated")], illegal, cost, edits, hashlib.sha256(text.encode()).hexdigest()


def brute(rows):
    out = {}
    for conv, row in damage(rows):
        out.setdefault(conv, []).extend([row] if row else [])
    return {c: brute_one(sorted(v, key=lambda r: (r[0] is not None, r[0]))) for c, v in out.items()}


def got(df):
    found = {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in df.collect()}
    return found


def test_given_conversations_whole(spark):
    sf_dir = "/root/testdata/sf0.01"
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").collect()]
    assert got(queries.QUERIES["op12_dialogue_repair"](spark, sf_dir)) == brute(rows)


def made(seed, convs, most):
    rng = random.Random(seed)
    rows = []
    for c in range(convs):
        for t in range(rng.randrange(1, most)):
            if rng.random() < 0.9:
                role = rng.choice(["user", "assistant", "system", "user", "assistant", "tool", None, "", "User"])
                text = rng.choice(["Yes.", "No.", "A fact!", "cut off", "", " \n", None, f"number {t}.", f"number {t}", "é🙂?\n", "a\nb."])
                rows.append((c if c != 3 else None, t if rng.random() < 0.97 or rows and rows[-1][1] is None else None, role, text))
    # a turn comes once, so that its place is given by the turn alone
    return list({(r[0], r[1]): r for r in rows}.values())


@pytest.mark.parametrize("branches", [12, 2, 1])
def test_random_conversations_in_pieces(spark, monkeypatch, branches):
    monkeypatch.setattr(dialogues, "BRANCHES", branches)
    rows = made(branches, 60, 10) + [(1000 + c, *r) for c, r in [(0, r[1:]) for r in made(7, 1, 300)]]
    df = spark.createDataFrame(rows, TURNS)
    assert got(dialogues.audited(dialogues.damaged(df))) == brute(rows)


def test_halves_meet_in_the_least_audit():
    rng = random.Random(5)
    for _ in range(3000):
        codes = bytes(rng.choice([0, 1, 2, 3, 5, 6, 9, 13]) for _ in range(rng.randrange(0, 9)))
        rows = [(i, {0: "s", 1: "u", 2: "a", 3: "x"}[c % 4], {0: f"{i}.", 1: f"{i}", 2: "", 3: ""}[c // 4]) for i, c in enumerate(codes)]
        edits, cost = dialogues.whole(codes)
        assert (cost, "".join(edits)) == brute_one(rows)[5:7]


def test_equal_rows_of_a_turn(spark):
    rows = [(1, 0, "user", "Same.")] * 50 + [(1, 1, "assistant", "An answer.")] * 3 + [(1, 5, "user", "Same.")]
    (r,) = dialogues.audited(spark.createDataFrame(rows, TURNS)).collect()
    assert (r.audit, r.cost, r.duplicate, r.gaps, r.illegal) == ("K" + "D" * 49 + "K" + "DDD", 49 * 4 + 12, 52, 3, 51)
    turns = dialogues.repaired(spark.createDataFrame(rows, TURNS)).collect()
    assert [(t.place, t.edit, t.turn, t.role, t.text) for t in sorted(turns, key=lambda t: t.place)] == [(0, "K", 0, "user", "Same."), (1, "K", 1, "assistant", "An answer.")]


def test_edges(spark):
    empty = hashlib.sha256(b"").hexdigest()
    dropped = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    rows = [(dropped, 0, "user", "Gone."), (-1, None, None, None), (-2, 3, "system", "w" * 300_000), (-3, 0, "tool", "Only.")]
    df = spark.createDataFrame(rows, TURNS).selectExpr("*", "'x' AS k1", "'x' AS rank", "'x' AS audit", "'x' AS at")
    found = got(dialogues.audited(dialogues.damaged(df)))
    assert found == brute(rows)
    assert found[dropped] == (0, 0, 0, 0, 0, 0, "", empty) and found[-1][6:] == ("D", empty)
    none = spark.createDataFrame([], TURNS)
    assert dialogues.audited(none).count() == 0 and dialogues.audited(dialogues.damaged(none)).count() == 0 and dialogues.repaired(none).count() == 0
