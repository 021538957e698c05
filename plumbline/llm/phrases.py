"""Phrase collocations mined with weighted acyclic automata.

A text is cut into pieces at ``[.,;:!?]`` and line breaks, and pieces into words at spaces and tabs. Each task reads its texts in
shards of a bounded number of words. All n-grams of a shard of one to four words, sorted, build a count transducer: an acyclic
automaton whose paths spell n-grams and whose states weigh how often. As the n-grams are sorted, one that follows shares the
states of the words it has in common with the one before and adds states from the first other word on.

A transducer is cut by prefix: an n-gram belongs to one of a number of ranges by a hash of its first three words, so the n-grams
behind a very common word or pair are spread over all ranges, and a range's part of a shard is an automaton of its own, with the
words it uses. Only these parts are shuffled. The parts of a range are united level by level, weights of equal paths
add up, and what is left after the last one has exact counts; paths of less than ``least`` then go.

Candidates are the paths of two words or more that are left. The parts they are cut into are asked for once each: the
requests of a range, sorted, build an automaton that is composed with the range's counts, walking both through equal words. A
part occurs at least as often as its phrase, so none is missing.

Defined cases: a null text has no word, a null language is ``und``; words keep their bytes but for A-Z in lower case; phrases
of equal score and count are in byte order; repeated rows count again; an empty table gives an empty result; extra columns are
not read. A text of any length is read in bounded steps; a shard may end inside of it, at most three words are read again.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.llm.shared import batches_of, given_back, shared_folder, written

LONGEST = 4
PREFIX = 3  # words that tell the range
SHARD = 1 << 20  # words that a task counts at once
STEP = 1 << 22  # bytes of a text that are split at once
RANGES = 4  # per shuffle partition
PENDING = 1 << 23  # bytes of packed automata that wait for their union
BATCH = 64  # texts or packed automata that go to a worker at once
UNKNOWN = "und"
SALTS = 256

# A-Z in lower case, each character that ends a piece a full stop, a tab a space.
_BYTES = bytes(46 if b in b".,;:!?\n\x0b\x0c\r" else 32 if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256))
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


class Automaton:
    """``words`` in byte order; per level, the arcs (source, label, weight) in order of source and label. An arc's place is the state it leads to."""

    def __init__(self, words: list[bytes], levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]]):
        self.words, self.levels = words, levels

    def __len__(self):
        return sum(len(level[1]) for level in self.levels)

    @classmethod
    def built(cls, words: list[bytes], grams: np.ndarray, weights: np.ndarray) -> Automaton:
        """From the distinct rows of ``grams``, labels padded with -1, in order."""
        new, state, levels = np.zeros(len(grams), bool), np.zeros(len(grams), np.int64), []
        new[:1] = True
        for k in range(grams.shape[1]):
            label = grams[:, k]
            new[1:] |= label[1:] != label[:-1]
            arc = new & (label >= 0)
            ends = label >= 0 if k + 1 == grams.shape[1] else (label >= 0) & (grams[:, k + 1] < 0)
            levels.append((state[arc], label[arc].astype(np.int64), np.where(ends, weights, 0)[arc]))
            state = np.cumsum(arc) - 1
        return cls(words, levels)

    def grams(self, least: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """Per level, the paths that weigh at least so much, as rows of labels in order, and their weights."""
        out = []
        for k, (source, label, weight) in enumerate(self.levels):
            at = np.flatnonzero(weight >= least)
            columns = [label[at]]
            up = source[at]
            for above in range(k - 1, -1, -1):
                columns.append(self.levels[above][1][up])
                up = self.levels[above][0][up]
            out.append((np.stack(columns[::-1], 1), weight[at]))
        return out

    def pruned(self, least: int) -> Automaton:
        found = self.grams(least)
        rows = np.concatenate([np.pad(g, ((0, 0), (0, len(self.levels) - g.shape[1])), constant_values=-1) for g, _ in found])
        weights = np.concatenate([w for _, w in found])
        order = np.lexsort(rows.T[::-1])
        used = _distinct(rows[rows >= 0])
        rows = np.where(rows[order] < 0, -1, np.searchsorted(used, rows[order]))
        return Automaton([self.words[i] for i in used], Automaton.built([], rows, weights[order]).levels)

    def composed(self, asked: Automaton) -> list[np.ndarray]:
        """Per level, the weights here of the paths of ``asked``, 0 where there is none."""
        index = {w: i for i, w in enumerate(self.words)}
        labels = np.array([index.get(w, -1) for w in asked.words], np.int64)
        state, out, many = np.zeros(1, np.int64), [], max(len(self.words), 1)
        for (source, label, weight), (a_source, a_label, _) in zip(self.levels, asked.levels):
            here, word = state[a_source], labels[a_label]
            keys, wanted = source * many + label, here * many + word
            at = np.minimum(np.searchsorted(keys, wanted), max(len(keys) - 1, 0))
            met = (here >= 0) & (word >= 0) & ((keys[at] == wanted) if len(keys) else False)
            state = np.where(met, at, -1)
            out.append(np.where(met, weight[at] if len(weight) else 0, 0))
        return out

    def packed(self) -> bytes:
        arrays = []
        for source, label, weight in self.levels:
            arrays += [_small(np.diff(source, prepend=0)), _small(label), _small(weight)]
        head = struct.pack("<I", len(self.words)) + b"".join(struct.pack("<IB", len(a), a.itemsize) for a in arrays)
        raw = b"".join([head, *(a.tobytes() for a in arrays), b" ".join(self.words)])
        return struct.pack("<QB", len(raw), len(self.levels)) + pa.compress(raw, codec="zstd", asbytes=True)

    @classmethod
    def unpacked(cls, data: bytes) -> Automaton:
        size, levels = struct.unpack_from("<QB", data)
        raw = pa.decompress(memoryview(data)[9:], decompressed_size=size, codec="zstd", asbytes=True)
        at, arrays = 4 + 5 * 3 * levels, []
        for i in range(3 * levels):
            n, width = struct.unpack_from("<IB", raw, 4 + 5 * i)
            arrays.append(np.frombuffer(raw, f"<u{width}", n, at).astype(np.int64))
            at += n * width
        words = raw[at:].split(b" ") if struct.unpack_from("<I", raw)[0] else []
        return cls(words, [(np.cumsum(arrays[3 * k]), arrays[3 * k + 1], arrays[3 * k + 2]) for k in range(levels)])


def _small(a: np.ndarray) -> np.ndarray:
    top = int(a.max()) if len(a) else 0
    return a.astype("<u1" if top < 1 << 8 else "<u2" if top < 1 << 16 else "<u4" if top < 1 << 32 else "<u8")


def united(automata: list[Automaton]) -> Automaton:
    """The automaton of all paths, with the sums of their weights."""
    if len(automata) == 1:
        return automata[0]
    words = sorted(set().union(*(a.words for a in automata)))
    index = {w: i for i, w in enumerate(words)}
    labels = [np.fromiter(map(index.__getitem__, a.words), np.int64, len(a.words)) for a in automata]
    states, levels = [np.zeros(1, np.int64)] * len(automata), []
    for k in range(len(automata[0].levels)):
        keys = np.concatenate([s[a.levels[k][0]] * len(words) + own[a.levels[k][1]] for a, s, own in zip(automata, states, labels)])
        found, sums, where = _summed(keys, np.concatenate([a.levels[k][2] for a in automata]))
        levels.append((found // len(words) if words else found, found % len(words) if words else found, sums))
        states = np.split(where, np.cumsum([len(a.levels[k][1]) for a in automata])[:-1])
    return Automaton(words, levels)


def _summed(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in order, the sums of their weights, and the place of each key among them."""
    order = np.argsort(keys, kind="stable")  # parts come in runs that are in order
    keys = keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    starts = np.flatnonzero(new)
    where = np.empty(len(keys), np.int64)
    where[order] = np.cumsum(new) - 1
    return keys[starts], np.add.reduceat(weights[order], starts) if len(keys) else weights, where


def _distinct(values: np.ndarray) -> np.ndarray:
    values = np.sort(values, axis=None)
    return values[np.flatnonzero(np.diff(values, prepend=values[:1] - 1))]


def _hash(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word)


def _scrambled(h):
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def range_of(lang: str, words: list[bytes], ranges: int) -> int:
    """The range of an n-gram by its first words."""
    with np.errstate(over="ignore"):
        h = np.uint64(_hash(lang.encode()))
        for k, w in enumerate(words[:PREFIX]):
            h = _scrambled(h + np.uint64(_hash(w)) * _MIX[k])
        return int(h % np.uint64(ranges))


def counted(ids: np.ndarray, tail: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Per length, the n-grams of ``ids`` (-1 ends a piece) in order: source, label, weight. None begins at the last ``tail`` places."""
    many = int(ids.max(initial=0)) + 1
    starts = len(ids) - tail
    state, levels = np.zeros(starts, np.int64), []
    at = np.arange(starts)
    for k in range(LONGEST):
        at = at[at + k < len(ids)]
        label = ids[at + k]
        at, label = at[label >= 0], label[label >= 0]
        found, sums, where = _summed(state[at] * many + label, np.ones(len(at), np.int64))
        state[at] = where
        levels.append((found // many, found % many, sums))
    return levels


def cut(lang: str, words: list[bytes], levels: list, ranges: int) -> Iterator[tuple[int, Automaton]]:
    """The automata of a shard's ranges."""
    own = np.fromiter(map(_hash, words), np.uint64, len(words))
    above, ranged = np.full(1, _hash(lang.encode()), np.uint64), []
    for k, (source, label, _) in enumerate(levels):
        if k < PREFIX:
            above = _scrambled(above[source] + own[label] * _MIX[k])
            ranged.append((above % np.uint64(ranges)).astype(np.int64))
        else:
            ranged.append(ranged[-1][source])
    # from the longest up, the states of each range: its own, and those its longer paths pass, which weigh nothing
    parts, passed = [None] * len(levels), np.zeros(0, np.int64)
    for k in range(len(levels) - 1, -1, -1):
        source, label, weight = levels[k]
        many = len(label)
        mine = ranged[k] * many + np.arange(many)
        keys = _distinct(np.concatenate([mine, passed]))
        where, arc = keys // max(many, 1), keys % max(many, 1)
        parts[k] = (where, arc, np.where(ranged[k][arc] == where, weight[arc], 0), label[arc])
        up = len(levels[k - 1][1]) if k else 1
        source_key = where * up + source[arc]
        passed = source_key
        parts[k] += (source_key,)
    bounds = [np.searchsorted(p[0], np.arange(ranges + 1)) for p in parts]
    source_at = [None] + [np.searchsorted(parts[k - 1][0] * len(levels[k - 1][1]) + parts[k - 1][1], parts[k][4]) for k in range(1, len(parts))]
    seen, place = np.zeros(len(words), bool), np.zeros(len(words), np.int64)
    for r in range(ranges):
        spans = [slice(b[r], b[r + 1]) for b in bounds]
        labels = [p[3][s] for p, s in zip(parts, spans)]
        if not len(labels[0]):
            continue
        seen[:] = False
        for own in labels:
            seen[own] = True
        used = np.flatnonzero(seen)
        place[used] = np.arange(len(used))
        out = []
        for k, s in enumerate(spans):
            source = np.zeros(len(labels[k]), np.int64) if not k else source_at[k][s] - bounds[k - 1][r]
            out.append((source, place[labels[k]], parts[k][2][s]))
        yield r, Automaton([words[i] for i in used], out)


class Shard:
    """Words of the texts of each language, until there are enough of them."""

    def __init__(self, ranges: int, size: int | None = None):
        self.ranges, self.size = ranges, size or SHARD
        self.clear()

    def clear(self) -> None:
        self.ids, self.held, self.index = {}, 0, _Numbers()

    def add(self, lang: str, text: bytes) -> Iterator[tuple]:
        """Takes a text in; yields what is full."""
        at, size = 0, len(text)
        while at < size:
            # a step ends behind a space, so words stay whole
            end = size if size - at <= STEP else text.find(b" ", at + STEP) + 1 or size
            tokens = text[at:end].translate(_BYTES).replace(b".", b" . ").split()
            own = self.ids.setdefault(lang, [])
            own.append(np.fromiter(map(self.index.__getitem__, tokens), np.int64, len(tokens)))
            self.held += len(tokens)
            at = end
            if self.held >= self.size:
                yield from self.flush(lang if at < size else None)
        self.ids.setdefault(lang, []).append(_END)

    def flush(self, open_lang: str | None = None) -> Iterator[tuple]:
        words = self.index.words()
        order = sorted(range(len(words)), key=words.__getitem__)
        rank = np.empty(len(words) + 1, np.int64)
        rank[order] = np.arange(len(words))
        rank[-1] = -1
        carry = None
        for lang, parts in self.ids.items():
            ids = np.concatenate(parts)
            tail = 0
            if lang == open_lang:
                tail = min(LONGEST - 1, len(ids))
                carry = [words[i] if i >= 0 else b"." for i in ids[len(ids) - tail :]]
            ids = rank[ids]
            used = _distinct(ids)
            used = used[used >= 0]
            ids = np.where(ids < 0, -1, np.searchsorted(used, ids))
            if not len(used):
                continue
            own = [words[order[i]] for i in used]
            for r, automaton in cut(lang, own, counted(ids, tail), self.ranges):
                yield lang, r, automaton
        self.clear()
        if carry is not None:
            self.ids[open_lang] = [np.array([self.index[w] for w in carry], np.int64)]


_END = np.full(1, -1, np.int64)


class _Numbers(dict):
    """A number per word, in order of appearance; the full stop is -1."""

    def __init__(self):
        super().__init__({b".": -1})

    def __missing__(self, word):
        value = self[word] = len(self) - 1
        return value

    def words(self) -> list[bytes]:
        return [w for w, i in self.items() if i >= 0]


COUNTS = "lang string, range int, automaton binary"


def _rows(out: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.int32()), pa.array([o[2].packed() for o in out], pa.binary())], names=["lang", "range", "automaton"]
    )


def _shards(ranges: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield from given_back(_sharded(ranges, batches))


def _sharded(ranges: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shard = Shard(ranges)

    def sent(found):
        out = []
        for o in found:
            out.append(o)
            if len(out) == 64:
                yield _rows(out)
                out = []
        if out:
            yield _rows(out)

    for batch in batches:
        for lang, text in zip(batch.column(0), batch.column(1)):
            yield from sent(shard.add(lang.as_py(), text.as_buffer().to_pybytes()))
    yield from sent(shard.flush())


class _Union:
    """The union of a range's automata: small ones wait, packed, until they weigh as much as what is united."""

    def __init__(self):
        self.done, self.waiting, self.held = None, [], 0

    def add(self, packed: bytes) -> None:
        self.waiting.append(packed)
        self.held += len(packed)
        if self.held >= max(PENDING, 2 * len(self.done or ())):
            self.all()

    def all(self) -> Automaton:
        if self.waiting:
            self.done = united([*([self.done] if self.done else []), *map(Automaton.unpacked, self.waiting)])
            self.waiting, self.held = [], 0
        return self.done


def _unions(least: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The counts of each range, which comes in one after the other; and the words counted there."""
    yield from given_back(_united_ranges(least, batches))


def _united_ranges(least: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def ended():
        total = union.all()
        return pa.RecordBatch.from_arrays(
            [pa.array([now[0]]), pa.array([now[1]], pa.int32()), pa.array([total.pruned(least).packed()], pa.binary()), pa.array([int(total.levels[0][2].sum())], pa.int64())],
            names=["lang", "range", "automaton", "n"],
        )

    now, union = None, None
    for batch in batches:
        for lang, r, data in zip(*batch.columns):
            key = (lang.as_py(), r.as_py())
            if key != now:
                if now is not None:
                    yield ended()
                now, union = key, _Union()
            union.add(data.as_buffer().to_pybytes())
    if now is not None:
        yield ended()


CANDIDATES = "lang string, phrase string, a long, lefts array<string>, rights array<string>, left_ranges array<int>, right_ranges array<int>"


def _candidates(ranges: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in CANDIDATES.split(", ")]
    for batch in batches:
        for lang, data in zip(batch.column(0).to_pylist(), batch.column(1)):
            automaton = Automaton.unpacked(data.as_buffer().to_pybytes())
            words = automaton.words
            for grams, weights in automaton.grams(1)[1:]:
                for at in range(0, len(grams), 4096):
                    out = []
                    for g, a in zip(grams[at : at + 4096].tolist(), weights[at : at + 4096].tolist()):
                        w = [words[i] for i in g]
                        cuts = range(1, len(w))
                        sides = [[w[:k] for k in cuts], [w[k:] for k in cuts]]
                        out.append((lang, b" ".join(w), a, *[[b" ".join(p) for p in s] for s in sides], *[[range_of(lang, p, ranges) for p in s] for s in sides]))
                    kinds = [pa.string(), pa.string(), pa.int64(), *[pa.list_(pa.string())] * 2, *[pa.list_(pa.int32())] * 2]
                    arrays = [_strings(c, t) for c, t in zip(zip(*out), kinds)] if out else [pa.array([], t) for t in kinds]
                    yield pa.RecordBatch.from_arrays(arrays, names=names)


def _strings(values, kind: pa.DataType) -> pa.Array:
    """An array of text that is given as UTF-8."""
    if kind == pa.string():
        return pa.array(values, pa.string())
    return pa.array(values, pa.list_(pa.binary())).cast(kind) if kind == pa.list_(pa.string()) else pa.array(values, kind)


def _looked_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The counts of the parts that are asked for, by composing both automata."""
    for batch in batches:
        for lang, data, parts in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
            counts = Automaton.unpacked(data.as_buffer().to_pybytes())
            split = sorted(p.encode().split(b" ") for p in parts)
            words = sorted({w for p in split for w in p})
            index = {w: i for i, w in enumerate(words)}
            rows = np.full((len(split), LONGEST), -1, np.int64)
            for i, p in enumerate(split):
                rows[i, : len(p)] = [index[w] for w in p]
            asked = Automaton.built(words, rows, np.ones(len(rows), np.int64))
            found, total = counts.composed(asked), []
            phrases = []
            for (grams, _), weights, (_, _, own) in zip(asked.grams(1), found, asked.levels):
                phrases += [b" ".join(words[i] for i in g) for g in grams.tolist()]
                total += weights[own > 0].tolist()
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(phrases), pa.string()), pa.array(phrases, pa.string()), pa.array(total, pa.int64())], names=["lang", "part", "f"])


def counts(docs: DataFrame, least: int, ranges: int) -> DataFrame:
    """(lang, range, automaton, n): the counts of all n-grams that occur ``least`` times, and the words counted in a range."""
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN)).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    parts = texts.mapInArrow(partial(_shards, ranges), COUNTS)
    return parts.repartition("lang", "range").sortWithinPartitions("lang", "range").mapInArrow(partial(_unions, least), f"{COUNTS}, n long")


def collocations(docs: DataFrame, least: int = 30, top: int | None = 2000, ranges: int | None = None) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first ``top`` phrases of each language (all without one) of ``docs`` (text, lang)."""
    spark = docs.sparkSession
    ranges = ranges or RANGES * int(spark.conf.get("spark.sql.shuffle.partitions"))
    folder = shared_folder(spark, "phrases")
    # an Arrow batch is held by the JVM, outside of its heap, and by the worker
    with batches_of(spark, BATCH):
        counted_ = written(counts(docs, least, ranges), "", f"{folder}/counts")
        found = written(counted_.select("lang", "automaton").mapInArrow(partial(_candidates, ranges), CANDIDATES), "", f"{folder}/candidates")
    asked = found.select("lang", F.explode(F.arrays_zip(F.concat("lefts", "rights").alias("part"), F.concat("left_ranges", "right_ranges").alias("range"))).alias("p"))
    asked = asked.select("lang", "p.range", "p.part").distinct().groupBy("lang", "range").agg(F.collect_list("part").alias("parts"))
    parts = asked.join(counted_, ["lang", "range"]).select("lang", "automaton", "parts").mapInArrow(_looked_up, "lang string, part string, f long")
    with batches_of(spark, BATCH):
        parts = written(parts, "", f"{folder}/parts")
    cuts = found.select("lang", "phrase", "a", F.posexplode(F.arrays_zip("lefts", "rights")).alias("k", "cut")).select("lang", "phrase", "a", "k", F.col("cut.lefts").alias("left"), F.col("cut.rights").alias("right"))
    cuts = cuts.join(parts.select("lang", F.col("part").alias("left"), F.col("f").alias("l")), ["lang", "left"])
    cuts = cuts.join(parts.select("lang", F.col("part").alias("right"), F.col("f").alias("r")), ["lang", "right"])
    score = F.expr("(CAST(a AS DECIMAL(20, 0)) * 2000000) DIV (CAST(l AS DECIMAL(20, 0)) + r)")
    scored = cuts.withColumn("score", score).groupBy("lang", "phrase").agg(F.max("a").alias("a"), F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    inside = _inside(found).groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = scored.join(inside, ["lang", "phrase"], "left").where("longer IS NULL OR CAST(longer AS DECIMAL(20, 0)) * 100 < CAST(a AS DECIMAL(20, 0)) * 80")
    kept = written(kept.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score"), "", f"{folder}/kept")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    if top is not None:
        # the first of each part of a language, then the first of those
        salt = F.pmod(F.xxhash64("phrase"), F.lit(SALTS))
        kept = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang", salt).orderBy(*order))).where(F.col("rank") <= top).drop("rank")
    ranked = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    ranked = ranked if top is None else ranked.where(F.col("rank") <= top)
    totals = counted_.groupBy("lang").agg(F.sum("n").alias("n"))
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def _inside(found: DataFrame) -> DataFrame:
    """(lang, phrase, a): the phrases of two words or more that lie inside a longer candidate, which occurs ``a`` times."""
    words = F.split("phrase", " ")
    spans = [(n, i) for n in range(2, LONGEST) for i in range(LONGEST - n + 1)]
    held = [F.when((F.size(words) > n) & (F.size(words) >= i + n), F.array_join(F.slice(words, i + 1, n), " ")) for n, i in spans]
    return found.select("lang", "a", F.explode(F.filter(F.array(*held), lambda x: x.isNotNull())).alias("phrase"))
