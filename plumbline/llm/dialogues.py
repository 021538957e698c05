"""Repair of conversation structure by Hirschberg's divide and conquer.

A repaired conversation has role initials ``(s?(ua)+)?``: a system turn at most, then user and assistant in turn. Four states
accept that: nothing yet, after system, after user, after assistant. Edits and their costs are Keep 0, Rerole (to user or
assistant) 3, Delete 4 and Insert (an empty user or assistant turn, anywhere) 3; a blank row, or one whose role and text came
earlier, must be deleted, and a row without a sentence's end that stays adds 3. In every state one role alone can be inserted
or given, so the edits' initials say all of a repair. The cheapest repair is wanted, of equal ones the one whose initials are
least.

A vector of four costs goes forward over the first half of a conversation and one backward over the second half; where their
sum is least the repair crosses the middle, and both halves are solved the same way, in space that does not grow with their
products. Ties are decided in the vectors: forward ones also hold the order of the four states' initials. A step ends with the
edit that uses up its row, so no state's initials begin another's, and that order follows from the order before and the step.

Conversations meet this in pieces of at most 4,096 rows. One that lies in a single piece is solved by a task at once. The
pieces of a longer one become 4 x 4 matrices of (cost, order), which are multiplied up in a tree of 4,096 branches and handed
down again as forward and backward vectors, so every piece learns the states at its ends and is solved on its own. Texts come
in only at the end: a conversation's rows pass its initials in order, one at a time.

Defined cases: a null role or text is one space; a null conv_id is a conversation; rows of one turn are ordered by a hash of
role and text, null turns first; equal rows of one turn are one row and its duplicates; a role without one of the initials
s, u, a (case matters) can only be given another or deleted; a conversation without rows has an empty audit and an empty
text; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from plumbline.llm.shared import numbered, remove, shared_folder, written

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
START, SYSTEM, USER, ASSISTANT = range(4)
AFTER = {(START, 0): SYSTEM, (START, 1): USER, (SYSTEM, 1): USER, (USER, 2): ASSISTANT, (ASSISTANT, 1): USER}
GIVEN = (USER, USER, ASSISTANT, USER)  # the state after the turn that can be inserted or given in each state
NAMES = {USER: "user", ASSISTANT: "assistant"}
INITIALS = "sua"
CUT, DUPLICATE, BLANK = 1, 2, 3
BRANCHES = 12  # bits
BLANKS = " \t\n\x0b\x0c\r"

Vector = list  # per state (cost, order) or None
Matrix = list  # per state before, a Vector


def _steps(code: int) -> Matrix:
    """(cost, initials) of each way through one row; ``code`` is its initial, 3 for any other, plus 4 times its fault."""
    role, fault = code % 4, code // 4
    out = []
    for before in range(4):
        best: Vector = [None] * 4
        state, cost, made = before, 0, ""
        for _ in range(4):
            ways = [(state, DELETE, "D")]
            if fault < DUPLICATE:
                more = TRUNCATED if fault == CUT else 0
                ways.append((GIVEN[state], REROLE + more, "R"))
                if (state, role) in AFTER:
                    ways.append((AFTER[state, role], KEEP + more, "K"))
            for after, price, edit in ways:
                way = (cost + price, made + edit)
                if best[after] is None or way < best[after]:
                    best[after] = way
            state, cost, made = GIVEN[state], cost + INSERT, made + "I"
        out.append(best)
    return out


STEPS = [_steps(code) for code in range(16)]
#: Inserts that end a repair in each state.
ENDS = ["", "II", "I", ""]
END_COSTS = [INSERT * len(e) for e in ENDS]
_FROM = [[(before, after, way) for before in range(4) for after, way in enumerate(steps[before]) if way] for steps in STEPS]


def advance(vector: Vector, matrix: Matrix) -> Vector:
    """``vector`` after a step or a piece: of the cheapest ways into a state the one that is first in order."""
    best: list = [None] * 4
    for before, has in enumerate(vector):
        if has is not None:
            for after, way in enumerate(matrix[before]):
                if way is not None:
                    found = (has[0] + way[0], has[1], way[1])
                    if best[after] is None or found < best[after]:
                        best[after] = found
    order = sorted(found[1:] for found in best if found is not None)
    return [None if found is None else (found[0], order.index(found[1:])) for found in best]


def backwards(costs: list, matrix: Matrix) -> list:
    """The cost from each state before a step or a piece on, by those after it."""
    return [min((way[0] + costs[after] for after, way in enumerate(row) if way is not None and costs[after] is not None), default=None) for row in matrix]


def crossing(forward: Vector, backward: list) -> int:
    """The state in which the wanted repair passes the place where both vectors meet."""
    return min((has[0] + backward[q], has[1], q) for q, has in enumerate(forward) if has is not None and backward[q] is not None)[2]


def only(state: int) -> Vector:
    return [(0, 0) if q == state else None for q in range(4)]


def solved(codes: bytes, before: int, after: int) -> list[str]:
    """The initials at each row of the wanted repair that leads from one state to the other."""
    out, todo = [], [(0, len(codes), before, after)] if codes else []
    while todo:
        i, j, q, x = todo.pop()
        if j - i == 1:
            out.append(STEPS[codes[i]][q][x][1])
            continue
        middle = (i + j) // 2
        forward, backward = only(q), [0 if s == x else None for s in range(4)]
        for code in codes[i:middle]:
            forward = advance(forward, STEPS[code])
        for code in reversed(codes[middle:j]):
            backward = backwards(backward, STEPS[code])
        c = crossing(forward, backward)
        todo += [(middle, j, c, x), (i, middle, q, c)]
    return out


def whole(codes: bytes) -> tuple[list[str], int]:
    """The initials at each row of a conversation, those that end it, and the cost."""
    forward = only(START)
    for code in codes:
        forward = advance(forward, STEPS[code])
    last = crossing(forward, END_COSTS)
    return [*solved(codes, START, last), ENDS[last]], forward[last][0] + END_COSTS[last]


def matrix_of(codes: bytes) -> Matrix:
    rows = [only(q) for q in range(4)]
    for code in codes:
        rows = [advance(r, STEPS[code]) for r in rows]
    return rows


def multiplied(matrices: list[Matrix]) -> Matrix:
    out = [only(q) for q in range(4)]
    for m in matrices:
        out = [advance(r, m) for r in out]
    return out


# Counts of consecutive rows: blank, duplicate, truncated, illegal, first and last initial, least and largest turn, distinct turns.
def counts_of(rows: list[dict]) -> list:
    n = [0, 0, 0, 0, None, None, None, None, 0]
    for r in rows:
        role, fault, extra, turn = r["code"] % 4, r["code"] // 4, r["extra"], r["turn"]
        n[0] += (1 + extra) * (fault == BLANK)
        n[1] += extra * (fault != BLANK) + (fault == DUPLICATE)
        n[2] += fault == CUT
        n[3] += extra + (n[5] is not None and not legal(n[5], role))
        n[5] = role
        if turn is not None and turn != n[7]:
            n[7] = turn
            n[8] += 1
            n[6] = turn if n[6] is None else n[6]
    if rows:
        n[4] = rows[0]["code"] % 4
    return n


def counts_joined(parts: list[list]) -> list:
    n = [0, 0, 0, 0, None, None, None, None, 0]
    for p in parts:
        if p[4] is None:
            continue
        for i in range(4):
            n[i] += p[i]
        n[3] += n[5] is not None and not legal(n[5], p[4])
        n[4], n[5] = p[4] if n[4] is None else n[4], p[5]
        if p[6] is not None:
            n[8] += p[8] - (p[6] == n[7])
            n[6], n[7] = p[6] if n[6] is None else n[6], p[7]
    return n


def legal(a: int, b: int) -> bool:
    return (a, b) in ((0, 1), (1, 2), (2, 1))


def report(counts: list, cost: int) -> list[int]:
    """gaps, blank, duplicate, truncated, illegal, cost."""
    gaps = 0 if counts[6] is None else counts[7] - counts[6] + 1 - counts[8]
    return [gaps, *counts[:4], cost]


def damaged(rows: DataFrame) -> DataFrame:
    """``rows`` (conv_id, turn, role, text) with one in four damaged by a hash of its place; ``copies`` is 0 for a row that is dropped."""
    place = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    rows = rows.select("conv_id", "turn", _named("role"), _named("text"), F.pmod(F.crc32(place), F.lit(20)).alias("damage"))
    text = F.when(F.col("damage") == 1, F.lit("")).when(F.col("damage") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.when(F.col("damage") == 0, 0).when(F.col("damage") == 3, 2).otherwise(1)
    return rows.select("conv_id", "turn", F.when(F.col("damage") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"), text.alias("text"), copies.alias("copies"))


def _named(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(" ")).alias(column)


def _keyed(rows: DataFrame) -> DataFrame:
    copies = F.col("copies").cast("long") if "copies" in rows.columns else F.lit(1).cast("long")
    rows = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), _named("role"), _named("text"), copies.alias("copies"))
    return rows.select("*", F.xxhash64("role", "text").alias("k1"), F.xxhash64(F.lit(12), "text", "role").alias("k2"))


def _coded(rows: DataFrame) -> DataFrame:
    """A row per distinct row of a conversation's turn: its code, and how many more there are."""
    initial = F.substring("role", 1, 1)
    role = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    stripped = F.rtrim("text", F.lit(BLANKS))
    fault = F.when(stripped == "", BLANK).when(F.substring(stripped, -1, 1).isin(".", "!", "?"), 0).otherwise(CUT)
    light = rows.where("copies > 0").select("conv_id", "turn", "k1", "k2", role.alias("role"), fault.alias("fault"), "copies")
    light = light.groupBy("conv_id", "turn", "k1", "k2").agg(F.max("role").alias("role"), F.max("fault").alias("fault"), F.sum("copies").alias("copies"))
    when = F.struct(F.col("turn").isNotNull().alias("named"), "turn")
    again = light.groupBy("conv_id", "k1", "k2").agg(F.min(when).alias("first"), F.count("*").alias("n")).where("n > 1")
    again = again.select(F.col("conv_id").alias("_conv"), F.col("k1").alias("_k1"), F.col("k2").alias("_k2"), "first")
    light = light.join(again, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("k1") == F.col("_k1")) & (F.col("k2") == F.col("_k2")), "left")
    fault = F.when((F.col("fault") != BLANK) & F.col("first").isNotNull() & (when > F.col("first")), DUPLICATE).otherwise(F.col("fault"))
    return light.select("conv_id", "turn", "k1", "k2", (F.col("role") + 4 * fault).cast("int").alias("code"), (F.col("copies") - 1).alias("extra"))


PLAN = "conv_id long, at long, audit string, report array<long>"
SUMMARY = "conv_id long, at long, costs array<long>, orders array<int>, counts array<long>"
ENDINGS = "conv_id long, at long, costs array<long>, orders array<int>, after array<long>"


def _batch(spark_schema, rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * len(spark_schema), spark_schema)], schema=spark_schema)


def _mapped(df: DataFrame, schema: str, each) -> DataFrame:
    """``each`` turns a row (as a dict) into rows."""
    kind = to_arrow_schema(df.sparkSession.createDataFrame([], schema).schema)
    return df.mapInArrow(partial(_each, kind, each), schema)


def _each(kind, each, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    memo: dict = {}
    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            yield _batch(kind, [out for row in batch.slice(at, 1024).to_pylist() for out in each(row, memo)])


def _edits(made: list[str], extras: list[int]) -> str:
    """The rows' initials with those of their equal rows; ``made`` may have one more, which ends the conversation."""
    return "".join(m + "D" * e for m, e in zip(made, [*extras, 0]))


def _alone(row: dict, memo: dict) -> Iterator[tuple]:
    codes, extras = bytes(r["code"] for r in row["rows"]), [r["extra"] for r in row["rows"]]
    found = memo.get(codes) or whole(codes)
    if len(codes) <= 16 and len(memo) < 20_000:
        memo[codes] = found
    yield row["conv_id"], row["at"], _edits(found[0], extras), report(counts_of(row["rows"]), found[1] + DELETE * sum(extras))


def _flat(matrix: list) -> tuple[list, list]:
    """Costs and orders of vectors, one after the other; None where there is no way."""
    cells = [c for row in matrix for c in row]
    return [c and c[0] for c in cells], [c and c[1] for c in cells]


def _read(costs: list, orders: list) -> Matrix:
    cells = [None if c is None else (c, o) for c, o in zip(costs, orders)]
    return [cells[i : i + 4] for i in range(0, len(cells), 4)]


def _summed(row: dict, memo: dict) -> Iterator[tuple]:
    matrix = matrix_of(bytes(r["code"] for r in row["rows"]))
    extra = DELETE * sum(r["extra"] for r in row["rows"])
    matrix = [[c and (c[0] + extra, c[1]) for c in v] for v in matrix]
    yield row["conv_id"], row["at"], *_flat(matrix), counts_of(row["rows"])


def _up(row: dict, memo: dict) -> Iterator[tuple]:
    matrix = multiplied([_read(p["costs"], p["orders"]) for p in row["parts"]])
    yield row["conv_id"], row["at"], *_flat(matrix), counts_joined([p["counts"] for p in row["parts"]])


def _down(row: dict, memo: dict) -> Iterator[tuple]:
    """The forward vector before, and the backward one after, each part."""
    matrices = [_read(p["costs"], p["orders"]) for p in row["parts"]]
    after = [row["after"]]
    for m in reversed(matrices[1:]):
        after.append(backwards(after[-1], m))
    (forward,) = _read(row["costs"], row["orders"])
    for part, m, behind in zip(row["parts"], matrices, reversed(after)):
        yield row["conv_id"], part["at"], *_flat([forward]), behind
        forward = advance(forward, m)


def _top(row: dict, memo: dict) -> Iterator[tuple]:
    """The whole of a conversation in pieces: what it counts and costs."""
    forward = multiplied([_read(row["costs"], row["orders"])])[START]
    last = crossing(forward, END_COSTS)
    yield row["conv_id"], -1, "", report(row["counts"], forward[last][0] + END_COSTS[last])


def _piece(row: dict, memo: dict) -> Iterator[tuple]:
    codes, extras = bytes(r["code"] for r in row["rows"]), [r["extra"] for r in row["rows"]]
    (forward,), behind = _read(row["costs"], row["orders"]), row["after"]
    matrix = matrix_of(codes)
    before = crossing(forward, backwards(behind, matrix))
    after = crossing(advance(forward, matrix), behind)
    made = solved(codes, before, after)
    # the backward vector after a conversation's last piece is that of its end
    ends = [ENDS[after]] if row["last"] else []
    yield row["conv_id"], row["at"], _edits([*made, *ends], extras), None


def _same(a: DataFrame, b: DataFrame) -> Column:
    return a["conv_id"].eqNullSafe(b["_conv"]) & (a["at"] == b["_at"])


def _branched(df: DataFrame) -> DataFrame:
    part = F.struct("at", "costs", "orders", "counts")
    return df.groupBy("conv_id", F.shiftright("at", BRANCHES).alias("above")).agg(F.sort_array(F.collect_list(part)).alias("parts")).withColumnRenamed("above", "at")


def planned(rows: DataFrame, folder: str) -> DataFrame:
    """(conv_id, at, audit, report): the initials of each piece of every conversation in order, and its report once."""
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("k1"), F.col("k2")]
    ranked = numbered(_coded(rows), order, "dialogue-rows")
    piece = F.shiftright("rank", BRANCHES).alias("at")
    pieces = ranked.groupBy("conv_id", piece).agg(F.sort_array(F.collect_list(F.struct("rank", "code", "extra", "turn"))).alias("rows"))
    pieces = written(pieces, "", f"{folder}/pieces")
    parts = pieces.groupBy(F.col("conv_id").alias("_conv")).agg(F.count("*").alias("n"), F.max("at").alias("_last")).where("n > 1")
    parts = written(parts, "", f"{folder}/in-parts")
    met = F.col("conv_id").eqNullSafe(F.col("_conv"))
    plans = _mapped(pieces.join(parts, met, "left_anti"), PLAN, _alone)
    gone = rows.groupBy("conv_id").agg(F.sum("copies").alias("n")).where("n = 0")
    none = F.array(*[F.lit(0).cast("long")] * 6)
    plans = plans.unionAll(gone.select("conv_id", F.lit(0).cast("long"), F.lit(""), none))
    if parts.isEmpty():
        return plans
    split = written(pieces.join(parts, met).select("conv_id", "at", "rows", (F.col("at") == F.col("_last")).alias("last")), "", f"{folder}/split")
    levels = [written(_mapped(split.select("conv_id", "at", "rows"), SUMMARY, _summed), "", f"{folder}/up0")]
    while not levels[-1].groupBy("conv_id").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        levels.append(written(_mapped(_branched(levels[-1]), SUMMARY, _up), "", f"{folder}/up{len(levels)}"))
    top = levels.pop()
    plans = plans.unionAll(_mapped(top, PLAN, _top))
    first, unordered = F.array(F.lit(0).cast("long"), *[F.lit(None).cast("long")] * 3), F.array(F.lit(0), *[F.lit(None).cast("int")] * 3)
    ends = top.select("conv_id", "at", first.alias("costs"), unordered.alias("orders"), F.array(*[F.lit(c).cast("long") for c in END_COSTS]).alias("after"))
    while levels:
        below = _branched(levels.pop())
        ends = ends.select(F.col("conv_id").alias("_conv"), F.col("at").alias("_at"), "costs", "orders", "after")
        met = below.join(ends, _same(below, ends)).select("conv_id", "at", "parts", "costs", "orders", "after")
        ends = written(_mapped(met, ENDINGS, _down), "", f"{folder}/down{len(levels)}")
    ends = ends.select(F.col("conv_id").alias("_conv"), F.col("at").alias("_at"), "costs", "orders", "after")
    met = split.join(ends, _same(split, ends)).select("conv_id", "at", "rows", "last", "costs", "orders", "after")
    return plans.unionAll(_mapped(met, PLAN, _piece))


TURNS = "conv_id long, place long, edit string, turn long, role string, text string"
DIGEST = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


class _Conversation:
    """One conversation on its way past its initials."""

    def __init__(self, conv_id):
        self.conv_id, self.parts, self.report = conv_id, [], None
        self.audit, self.at, self.state, self.place = None, 0, START, 0

    def inserted(self) -> Iterator[tuple]:
        if self.audit is None:
            self.audit = "".join(self.parts)
        while self.audit.startswith("I", self.at):
            self.state = GIVEN[self.state]
            yield self.turn("I", None, NAMES[self.state], "")

    def turn(self, edit, turn, role, text) -> tuple:
        if edit == "I":
            self.at += 1
        self.place += 1
        return self.conv_id, self.place - 1, edit, turn, role, text

    def passed(self, row: dict) -> Iterator[tuple]:
        for _ in range(row["copies"]):
            yield from self.inserted()
            edit = self.audit[self.at]
            self.at += 1
            if edit == "D":
                continue
            self.state = GIVEN[self.state] if edit == "R" else AFTER[self.state, INITIALS.index(row["role"][0])]
            yield self.turn(edit, row["turn"], NAMES[self.state] if edit == "R" else row["role"], row["text"])


def _walked(kind, digests: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repaired turns, or a digest of each conversation, of rows in order; a conversation's initials come before its rows."""
    out: list[tuple] = []
    now, sha = None, None

    def take(turns):
        for t in turns:
            if digests:
                sha.update(f"{chr(10) if t[1] else ''}{t[4]}:{t[5]}".encode())
            else:
                out.append(t)

    def ended():
        take(now.inserted())
        if now.at != len(now.audit):
            raise ValueError(f"conversation {now.conv_id}: {len(now.audit) - now.at} edits are left over")
        if digests:
            gaps, blank, duplicate, truncated, illegal, cost = now.report
            out.append((now.conv_id, gaps, blank, duplicate, truncated, illegal, cost, now.audit, sha.hexdigest()))

    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            for row in batch.slice(at, 1024).to_pylist():
                if now is None or now.conv_id != row["conv_id"]:
                    if now is not None:
                        ended()
                    now, sha = _Conversation(row["conv_id"]), hashlib.sha256()
                if row["audit"] is not None:
                    now.parts.append(row["audit"])
                    now.report = row["report"] or now.report
                else:
                    take(now.passed(row))
            if out:
                yield _batch(kind, out)
                out = []
    if now is not None:
        ended()
    if out:
        yield _batch(kind, out)


def _repair(rows: DataFrame, schema: str, digests: bool) -> DataFrame:
    spark = rows.sparkSession
    folder = shared_folder(spark, "dialogues")
    rows = _keyed(rows)
    plans = written(planned(rows, folder), "", f"{folder}/plans")
    for old in ("pieces", "split"):
        remove(spark, f"{folder}/{old}")
    null = lambda kind: F.lit(None).cast(kind)
    heads = plans.select("conv_id", "at", "audit", "report", null("long").alias("turn"), null("long").alias("k1"), null("long").alias("k2"), null("string").alias("role"), null("string").alias("text"), null("long").alias("copies"))
    turns = rows.where("copies > 0").select("conv_id", null("long").alias("at"), null("string").alias("audit"), null("array<long>").alias("report"), "turn", "k1", "k2", "role", "text", "copies")
    ordered = [F.col("conv_id").asc_nulls_first(), F.col("at").asc_nulls_last(), F.col("turn").asc_nulls_first(), F.col("k1"), F.col("k2")]
    met = heads.unionAll(turns).repartition("conv_id").sortWithinPartitions(*ordered)
    kind = to_arrow_schema(spark.createDataFrame([], schema).schema)
    return met.select("conv_id", "audit", "report", "turn", "role", "text", "copies").mapInArrow(partial(_walked, kind, digests), schema)


def repaired(rows: DataFrame) -> DataFrame:
    """The turns of every repaired conversation of ``rows`` (conv_id, turn, role, text; ``copies`` if there): conv_id, place, edit, turn, role, text."""
    return _repair(rows, TURNS, False)


def audited(rows: DataFrame) -> DataFrame:
    """One row per conversation: what was wrong, the cost and initials of its repair, and a digest of the repaired turns."""
    return _repair(rows, DIGEST, True)
