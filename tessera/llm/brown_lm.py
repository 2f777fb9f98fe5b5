"""LM scoring (2): Brown class-based n-grams.

1. Counts: all training tokens (words lower-cased A-Z, then one end token a text) are counted by
   64-bit word hash; the table grows with the corpus and stays distributed. N, V are its totals.
2. Seeds: the ``CLUSTERED`` most frequent words are clustered by exchange on one matrix of unit bigrams
   (the other head words in frequency bands), one word after the other, until nothing moves.
3. Sweeps: every one of the ``HEAD`` most frequent words chooses its class. Tasks count how often a
   word stands before and after each class, the counts are summed by word, and each word goes to the
   class that raises the likelihood of the class bigrams most. All words move at once, so the bigrams
   are counted anew after each sweep, and a sweep that lowered the likelihood is taken back. Rarer
   words, and unknown ones, are the class ``rare``; the end token is a class.
4. Scores: P(w | v) = T(class w | class v) * E(w | class w), with
       T(k | j) = (n(j, k) + ALPHA * P(k)) / (n(j) + ALPHA),  P(k) = (n(k) + [k is rare]) / (N + 1)
       E(w | k) = c(w) / n(k),   for rare words (c(w) + 1) / (n(rare) + V(rare) + 1)
   which sums to one over all words and the unknown one. The head's counts and classes (bounded by
   ``HEAD``) are sent to the tasks; rare words leave them packed by bucket of the word's hash and meet
   their counts there, one path at every size: both scores need only the sum of log10(c + 1) over them.

Texts are cut into words twice: once for the counts, and once when the head is known; then the training
texts are written as the places of their words in the head, which the seeds and every sweep read.

Defined cases: null and empty texts are one end token; a null id trains and is not held out; rows
that repeat an id are texts of their own; without training tokens both scores are 0; an empty table
gives an empty table; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import stage
from tessera.llm.registry import query, table
from tessera.llm.words import U, Chunk, chunks

HEAD = 1 << 20
CLUSTERED = 512
CLASSES = 32
SWEEPS = 20
MOVES = 3  # sweeps over all head words
ALPHA = 1.0
BANDS = 24
END = U(0x454E44)  # hash of the end token
#: Units of tokens: the end, classes 1..CLASSES, rare words; head words not placed yet.
END_UNIT, RARE, UNPLACED = 0, CLASSES + 1, CLASSES + 2
UNITS = CLASSES + 3
#: Units of the seeds' matrix.
FIRST_BAND = CLUSTERED + 1
SEED_RARE = FIRST_BAND + BANDS
SEEDS = SEED_RARE + 1
BLOCKS = 16
#: A word's counts: before it, after it, and pairs with itself; a task merges what it has counted beyond KEYS.
COLUMNS = 2 * UNITS + 1
KEYS = 1 << 21
ROWS = 1 << 11
#: Tokens that a task looks at together, and rare words and their counts in a bucket.
AT_ONCE = 1 << 18
BUCKET = 1 << 21


def held_out(id_col: str):
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 7 == 2, F.lit(False))


def tokens(c: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, end tokens included, and the n + 1 positions where texts begin."""
    edges = c.row0 + np.arange(c.n + 1)
    out = np.full(edges[-1], END, U)
    out[np.arange(len(c.start)) + c.rows()] = c.hashes()
    return out, edges


def _count(batches):
    for b in batches:
        seen = [np.unique(tokens(c)[0], return_counts=True) for c in chunks(b.column(0), lower=True)]
        if seen:
            h, of = np.unique(np.concatenate([s[0] for s in seen]), return_inverse=True)
            n = np.bincount(of, weights=np.concatenate([s[1] for s in seen])).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], names=["h", "n"])


class Head:
    """The most frequent words, sorted by hash: counts, seed units and units."""

    def __init__(self, h: np.ndarray, c: np.ndarray):
        """Both in order of frequency."""
        words = h != END
        h, c = h[words], c[words]
        seed = np.where(np.arange(len(h)) < CLUSTERED, 1 + np.arange(len(h)), FIRST_BAND + np.minimum(np.log2(np.maximum(c, 1)).astype(np.int64), BANDS - 1))
        order = np.argsort(h)
        self.h, self.c, self.seed = h[order], c[order], seed[order].astype(np.int32)
        self.unit = np.full(len(h), UNPLACED, np.int32)

    def place(self, asked: np.ndarray) -> np.ndarray:
        """Index of each token among the head words; one more is the end, two more a rare word."""
        n = len(self.h)
        at = np.searchsorted(self.h, asked)
        if n:
            at = np.where(self.h[np.minimum(at, n - 1)] == asked, at, n + 1)
        else:
            at = np.full(len(asked), n + 1)
        return np.where(asked == END, n, at)

    def units(self) -> np.ndarray:
        """Of each place."""
        return np.append(self.unit, [END_UNIT, RARE]).astype(np.int8)

    def seeds(self) -> np.ndarray:
        return np.append(self.seed, [END_UNIT, SEED_RARE]).astype(np.int32)

    def look(self, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, unit) of each token; the unit of a word that is not here is RARE."""
        at = self.place(asked)
        return at, self.units()[at].astype(np.int32)


def before(unit: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """The unit before each token; texts begin after an end."""
    out = np.empty_like(unit)
    out[1:] = unit[:-1]
    out[edges[:-1]] = END_UNIT
    return out


def _places(shared):
    """A text's tokens as places (``Head.place``) of four bytes, one row a text."""
    def run(batches):
        for b in batches:
            for c in chunks(b.column(0), lower=True):
                h, edges = tokens(c)
                at = shared.value.place(h).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.Array.from_buffers(pa.binary(), c.n, [None, pa.py_buffer((edges * 4).astype(np.int32)), pa.py_buffer(at)])], names=["places"])
    return run


def placed(column: pa.Array):
    """(places, edges) of consecutive texts, about ``AT_ONCE`` tokens at a time; a longer text is not cut."""
    wide = pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    first = 0
    while first < len(column):
        last = max(int(np.searchsorted(offsets, offsets[first] + 4 * AT_ONCE, side="right")) - 1, first + 1)
        yield np.frombuffer(column.buffers()[2], np.int32, (offsets[last] - offsets[first]) // 4, offsets[first]).astype(np.int64), (offsets[first:last + 1] - offsets[first]) // 4
        first = last


def _bigrams(shared):
    def run(batches):
        total, seeds = np.zeros(SEEDS * SEEDS, np.int64), shared.value.seeds()
        for b in batches:
            for at, edges in placed(b.column(0)):
                unit = seeds[at]
                total += np.bincount(before(unit, edges).astype(np.int64) * SEEDS + unit, minlength=SEEDS * SEEDS)
        if total.any():
            parts = np.array_split(total, BLOCKS)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(BLOCKS, dtype=np.int32)), pa.array([p.tobytes() for p in parts], pa.binary())], names=["block", "counts"])
    return run


def _merge(keys: list[np.ndarray], times: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and the sums of their times."""
    k, t = np.concatenate(keys), np.concatenate(times)
    order = np.argsort(k, kind="stable")
    k, t = k[order], t[order]
    first = np.flatnonzero(np.append(True, k[1:] != k[:-1])) if len(k) else np.zeros(0, np.int64)
    return k[first], np.add.reduceat(t, first) if len(k) else t


def _packed(key: np.ndarray, times: np.ndarray) -> pa.RecordBatch:
    """One row a place; an entry is times * 256 + column."""
    place, column = key // COLUMNS, key % COLUMNS
    first = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
    lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(key)).astype(np.int32)), pa.array(times << 8 | column))
    return pa.RecordBatch.from_arrays([pa.array(place[first]), lists], names=["place", "counts"])


def _unpacked(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    place = np.repeat(b.column(0).to_numpy(), b.column(1).value_lengths().to_numpy())
    x = b.column(1).flatten().to_numpy()
    return place * COLUMNS + (x & 255), x >> 8


def _contexts(shared, units_of):
    """How often each place stands after and before each unit."""
    def run(batches):
        head = shared.value
        units, keys, times, held = units_of.value.astype(np.int64), [], [], 0
        for b in batches:
            for here, edges in placed(b.column(0)):
                last = np.empty_like(here)
                last[1:] = here[:-1]
                last[edges[:-1]] = len(head.h)
                own = here == last
                both = np.concatenate((here * COLUMNS + np.where(own, 2 * UNITS, units[last]), (last * COLUMNS + UNITS + units[here])[~own]))
                k, t = np.unique(both, return_counts=True)
                keys.append(k)
                times.append(t.astype(np.int64))
                held += len(k)
                if held > KEYS:
                    k, t = _merge(keys, times)
                    if len(k) > KEYS // 2:
                        yield _packed(k, t)
                        k, t = k[:0], t[:0]
                    keys, times, held = [k], [t], len(k)
        if held:
            yield _packed(*_merge(keys, times))
    return run


def _sum(batches):
    """The places of this task, each in one row."""
    keys, times, held = [], [], 0
    for b in batches:
        k, t = _unpacked(b)
        keys.append(k)
        times.append(t)
        held += len(k)
        if held > KEYS:
            k, t = _merge(keys, times)
            keys, times, held = [k], [t], len(k) // 2
    if keys:
        k, t = _merge(keys, times)
        edges = np.searchsorted(k // COLUMNS, (k // COLUMNS)[::ROWS * 32]) if len(k) else []
        for lo, hi in zip(edges, [*edges[1:], len(k)], strict=True):
            if hi > lo:
                yield _packed(k[lo:hi], t[lo:hi])


def _pairs(units):
    """Bigrams of units, from the places' counts of what stands before them (in one row a task)."""
    def run(batches):
        total = np.zeros((UNITS, UNITS), np.int64)
        for b in batches:
            k, t = _unpacked(b)
            place, column = k // COLUMNS, k % COLUMNS
            unit = units.value[place].astype(np.int64)
            left = np.where(column == 2 * UNITS, unit, column)
            use = left < UNITS
            np.add.at(total, (left[use], unit[use]), t[use])
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["counts"])
    return run


def choose(pair: np.ndarray, here: np.ndarray, into: np.ndarray, out: np.ndarray, own: np.ndarray, classes: int) -> np.ndarray:
    """The unit in 1..classes that each word raises the likelihood most in, all other words held.

    ``pair`` are the bigrams of units with every word in its unit ``here``; ``into`` and ``out`` count
    the units before and after each word, without its ``own`` pairs with itself."""
    a = pair.astype(float)
    ks, w = np.arange(1, classes + 1), np.arange(len(here))
    at = here[:, None] == ks
    into, out, own = into.astype(float), out.astype(float), own.astype(float)
    gain = np.zeros((len(here), classes))
    for counts, other, cells in ((out, into, a), (into, out, a.T)):
        b, j = np.nonzero(counts)
        n, same = counts[b, j][:, None], (j == here[b])[:, None]
        rest = cells[ks][:, j].T - at[b] * (n + same * own[b][:, None]) - same * other[b][:, ks]
        order = xlogx(rest + n) - xlogx(rest)
        if len(b):
            first = np.flatnonzero(np.append(True, b[1:] != b[:-1]))
            gain[b[first]] += np.add.reduceat(order, first)
        total = counts.sum(1)[:, None] + own[:, None]
        left = cells.sum(1)[ks] - at * total
        gain -= xlogx(left + total) - xlogx(left)
    o, i = out[:, ks], into[:, ks]
    corner = a[ks, ks] - at * (o + i + own[:, None])
    gain += xlogx(corner + o + i + own[:, None]) - xlogx(corner + o) - xlogx(corner + i) + xlogx(corner)
    best = gain.argmax(1)
    inside = (here >= 1) & (here <= classes)
    stay = inside & (gain[w, best] <= gain[w, np.where(inside, here - 1, 0)] + 1e-9)
    return np.where(stay, here, 1 + best).astype(np.int32)


def _choose(units_of, pair: np.ndarray, only_new: bool, classes: int):
    def run(batches):
        units = units_of.value
        for b in batches:
            for lo in range(0, b.num_rows, ROWS):
                part = b.slice(lo, ROWS)
                place = part.column(0).to_numpy()
                k, t = _unpacked(part)
                row = np.repeat(np.arange(len(place)), part.column(1).value_lengths().to_numpy())
                counts = np.zeros((len(place), COLUMNS))
                np.add.at(counts, (row, k % COLUMNS), t)
                here = units[place].astype(np.int32)
                moves = (here != END_UNIT) & (here != RARE) & ((here == UNPLACED) | (not only_new))
                there = here.copy()
                if moves.any():
                    there[moves] = choose(pair, here[moves], counts[moves, :UNITS], counts[moves, UNITS:2 * UNITS], counts[moves, 2 * UNITS], classes)
                moved = there != here
                yield pa.RecordBatch.from_arrays([pa.array(place[moved]), pa.array(there[moved])], names=["place", "unit"])
    return run


def likelihood(pair: np.ndarray) -> float:
    """Of the class bigrams, up to what no exchange changes."""
    a = pair.astype(float)
    return xlogx(a).sum() - xlogx(a.sum(0)).sum() - xlogx(a.sum(1)).sum()


def _add(batches):
    """Sums of the matrix blocks in this task, by block."""
    total: dict[int, np.ndarray] = {}
    for b in batches:
        for k, raw in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            n = np.frombuffer(raw.as_buffer(), np.int64)
            total[k] = total[k] + n if k in total else n
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([n.tobytes() for n in total.values()], pa.binary())], names=["block", "counts"])


def _add_block(pdf: pd.DataFrame) -> pd.DataFrame:
    total = sum(np.frombuffer(x, np.int64) for x in pdf["counts"])
    return pd.DataFrame({"block": [pdf["block"].iloc[0]], "counts": [total.tobytes()]})


def xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def exchange(n: np.ndarray, movable: np.ndarray, classes: int, sweeps: int = SWEEPS) -> np.ndarray:
    """Class of each unit: ``movable`` units share ``classes`` classes, every other unit is one."""
    n = n.astype(float)
    cls = np.empty(len(n), np.int64)
    cls[movable] = np.arange(len(movable)) % classes
    fixed = np.setdiff1d(np.arange(len(n)), movable)
    cls[fixed] = classes + np.arange(len(fixed))
    k = classes + len(fixed)
    a = np.zeros((k, k))
    np.add.at(a, (cls[:, None], cls[None, :]), n)
    for _ in range(sweeps):
        moved = 0
        for w in movable:
            here = cls[w]
            out, into = n[w].copy(), n[:, w].copy()
            own, out[w], into[w] = n[w, w], 0.0, 0.0
            out, into = np.bincount(cls, weights=out, minlength=k), np.bincount(cls, weights=into, minlength=k)
            if not out.any() and not into.any() and not own:
                continue
            a[here] -= out
            a[:, here] -= into
            a[here, here] -= own
            # whatever class takes the word, the others' rows and columns hold their pairs with it
            row, col = (a.sum(1) + into)[:classes], (a.sum(0) + out)[:classes]
            rows, cols = a[:classes], a[:, :classes].T
            gain = (xlogx(rows + out) - xlogx(rows)).sum(1) + (xlogx(cols + into) - xlogx(cols)).sum(1)
            d = np.arange(classes)
            corner = a[d, d]
            # the corner cell takes both vectors and the word's own pairs
            gain += xlogx(corner + out[d] + into[d] + own) - xlogx(corner + out[d]) - xlogx(corner + into[d]) + xlogx(corner)
            gain -= xlogx(row + out.sum() + own) - xlogx(row) + xlogx(col + into.sum() + own) - xlogx(col)
            there = int(np.argmax(gain))
            if gain[there] <= gain[here] + 1e-9:
                there = here
            cls[w] = there
            a[there] += out
            a[:, there] += into
            a[there, there] += own
            moved += there != here
        if not moved:
            break
    return cls


class Model:
    """Log tables for the tasks. ``vocabulary`` is the number of distinct training tokens, ``rare_words`` those outside the head."""

    def __init__(self, head: Head, bigrams: np.ndarray, total: int, vocabulary: int, rare_words: int):
        """``bigrams`` of the units of ``head``."""
        self.head, self.total, self.vocabulary, self.rare_words = head, total, vocabulary, rare_words
        self.cls = np.arange(UNITS)  # every unit is a class
        k = UNITS
        pair = bigrams.astype(float)
        size = pair.sum(0)
        share = (size + (np.arange(k) == self.cls[RARE])) / (total + 1)  # the unknown word counts as one
        with np.errstate(divide="ignore"):
            self.transition = np.log10((pair + ALPHA * share) / (pair.sum(1, keepdims=True) + ALPHA)) if total else np.zeros((k, k))
            self.emission = np.log10(np.maximum(head.c, 1)) - np.log10(np.maximum(size[head.unit], 1))
        rare = size[self.cls[RARE]]
        self.rare = -np.log10(rare + rare_words + 1)
        self.base = np.log10(head.c + 1.0)
        self.floor = -np.log10(total + vocabulary + 1)
        self.end_count = int(size[self.cls[END_UNIT]])

    def score(self, c: Chunk) -> tuple[np.ndarray, ...]:
        """For each text: tokens, known head tokens, base and score without the rare words' counts, rare words, their edges."""
        h, edges = tokens(c)
        at, unit = self.head.look(h)
        prev = before(unit, edges)
        rare, end = unit == RARE, unit == END_UNIT
        n = np.diff(edges)
        word = ~rare & ~end
        base = np.full(len(h), self.floor)
        base[word] += self.base[at[word]]
        base[end] += np.log10(self.end_count + 1)
        score = self.transition[prev, unit].copy()
        score[word] += self.emission[at[word]]
        score[rare] += self.rare
        known = word | (end & (self.end_count > 0))
        text = np.repeat(np.arange(c.n), n)
        sums = [np.bincount(text, weights=x, minlength=c.n) for x in (known, base, score)]
        left = np.bincount(text[rare], minlength=c.n)
        return n, sums[0].astype(np.int64), sums[1], sums[2], h[rare], left


def _score(shared):
    def run(batches):
        uid = (TaskContext.get().partitionId()) << 33
        for b in batches:
            parts = [shared.value.score(c) for c in chunks(b.column(1), lower=True)]
            if not parts:
                continue
            col = [np.concatenate([p[k] for p in parts]) for k in range(6)]
            rows = len(col[0])
            words = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(col[5]))).astype(np.int32)), pa.array(col[4].view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(uid + np.arange(rows)), b.column(0), pa.array(col[0]), pa.array(col[1]), pa.array(col[2]), pa.array(col[3]), words, pa.array(col[5])],
                                             names=["uid", "_id", "n_tokens", "known", "base", "score", "rare", "n_rare"])
            uid += rows
    return run


def _pack(group: np.ndarray, *columns: np.ndarray) -> pa.RecordBatch:
    """One row a group: its number and its part of each column."""
    order = np.argsort(group, kind="stable")
    first = np.flatnonzero(np.append(True, np.diff(group[order]) != 0)) if len(order) else np.zeros(0, np.int64)
    rows = np.split(order, first[1:]) if len(order) else []
    cells = [pa.array([c[r].tobytes() for r in rows], pa.binary()) for c in columns]
    return pa.RecordBatch.from_arrays([pa.array(group[order][first].astype(np.int64)), *cells], names=["k", *"abc"[:len(columns)]])


def _unpack(packed: pa.Table, name: str, dtype) -> np.ndarray:
    return np.concatenate([np.zeros(0, dtype), *(np.frombuffer(x.as_buffer(), dtype) for x in packed[name])])


def _rare_words(buckets: int):
    """Rows (uid, rare) to packed (uid, word) by the word's bucket."""
    def run(batches):
        for b in batches:
            h = b.column(1).flatten().to_numpy().view(U)
            yield _pack((h % U(buckets)).astype(np.int64), np.repeat(b.column(0).to_numpy(), b.column(1).value_lengths().to_numpy()), h)
    return run


def _rare_counts(shared, buckets: int):
    """Rows (h, c) to packed (word, count) by bucket, without the head and the end."""
    def run(batches):
        for b in batches:
            h = b.column(0).to_numpy().view(U)
            rare = np.flatnonzero(shared.value.head.place(h) == len(shared.value.head.h) + 1)
            h = h[rare]
            yield _pack((h % U(buckets)).astype(np.int64), h, b.column(1).to_numpy()[rare])
    return run


def _meet(words: pa.Table, counts: pa.Table) -> pa.Table:
    """A bucket's words and counts to each text's known words and sum of log10(c + 1), packed by the part of the texts."""
    uid, h = _unpack(words, "a", np.int64), _unpack(words, "b", U)
    known, c = _unpack(counts, "a", U), _unpack(counts, "b", np.int64)
    order = np.argsort(known)
    known, c = known[order], c[order]
    at = np.searchsorted(known, h)
    there = np.flatnonzero(at < len(known))
    there = there[known[at[there]] == h[there]]
    texts, of = np.unique(uid[there], return_inverse=True)
    n = np.bincount(of, minlength=len(texts)).astype(np.int64)
    return pa.Table.from_batches([_pack(texts >> 33, texts, n, np.bincount(of, np.log10(c[at[there]] + 1.0), len(texts)))])


def _add_rare(texts: pa.Table, sums: pa.Table) -> pa.Table:
    """The texts of a part with their rare words' sums added."""
    uid, n, s = _unpack(sums, "a", np.int64), _unpack(sums, "b", np.int64), _unpack(sums, "c", np.float64)
    own = texts["uid"].to_numpy()
    names = np.sort(own)  # every uid of the sums is one of them
    at = np.searchsorted(names, uid)
    place = np.searchsorted(names, own)
    more, known = np.bincount(at, s, len(names))[place], np.bincount(at, n, len(names)).astype(np.int64)[place]
    return pa.table([texts["_id"], texts["n_tokens"], pa.array(texts["known"].to_numpy() + known), pa.array(texts["base"].to_numpy() + more), pa.array(texts["score"].to_numpy() + more)], names=["_id", "n_tokens", "n_known", "base_score", "score"])


def seed(texts: DataFrame, head: Head, shared, classes: int = CLASSES) -> int:
    """``texts`` as places. Sets the units of the ``CLUSTERED`` most frequent words; the number of classes."""
    parts = texts.mapInArrow(_bigrams(shared), "block int, counts binary")
    if texts.rdd.getNumPartitions() > 256:  # a first round of sums, so that no block gathers one matrix from every task
        parts = parts.repartition(64).mapInArrow(_add, "block int, counts binary")
    blocks = {r.block: np.frombuffer(r.counts, np.int64) for r in parts.groupBy("block").applyInPandas(_add_block, "block int, counts binary").collect()}
    matrix = np.concatenate([blocks[k] for k in range(BLOCKS)]).reshape(SEEDS, SEEDS) if blocks else np.zeros((SEEDS, SEEDS), np.int64)
    movable = np.arange(1, 1 + min(CLUSTERED, len(head.h)))
    classes = min(classes, max(1, len(movable)))
    of = exchange(matrix, movable, classes)
    seeds = head.seed < FIRST_BAND
    head.unit[seeds] = 1 + of[head.seed[seeds]]
    return classes


def sweep(texts: DataFrame, head: Head, shared, classes: int, moves: int = MOVES) -> np.ndarray:
    """Lets every head word choose its unit; the bigrams of the units."""
    spark, best = texts.sparkSession, None
    for turn in range(moves + 1):
        units = spark.sparkContext.broadcast(head.units())
        rows = texts.mapInArrow(_contexts(shared, units), "place long, counts array<long>").repartition("place")
        rows = stage(rows.mapInArrow(_sum, "place long, counts array<long>"))
        pair = np.zeros((UNITS, UNITS), np.int64)
        for r in rows.mapInArrow(_pairs(units), "counts binary").collect():
            pair += np.frombuffer(r.counts, np.int64).reshape(UNITS, UNITS)
        new = bool((head.unit == UNPLACED).any())
        if best and likelihood(pair) <= best[0]:
            head.unit = best[1]
            return best[2]
        if not new:
            best = (likelihood(pair), head.unit.copy(), pair)
        if turn == moves:
            break
        moved = rows.mapInArrow(_choose(units, pair, new, classes), "place long, unit int").toArrow()  # at most one row a head word
        if not moved.num_rows:
            break
        head.unit = head.unit.copy()
        head.unit[moved["place"].to_numpy()] = moved["unit"].to_numpy()
    return pair


def fit(train: DataFrame, text_col: str, head: int = HEAD) -> tuple[Model, DataFrame]:
    """The model and the written counts (h, c) of all training tokens."""
    spark = train.sparkSession
    texts = train.select(F.col(text_col).cast("string").alias("t"))
    counts = stage(texts.mapInArrow(_count, "h long, n long").groupBy("h").agg(F.sum("n").alias("c")))
    total = counts.agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).first()
    top = counts.orderBy(F.desc("c"), "h").limit(head).toArrow()  # at most ``head`` rows
    words = Head(top["h"].to_numpy().view(U), top["c"].to_numpy())
    shared = spark.sparkContext.broadcast(words)  # its units change here only
    places = stage(texts.mapInArrow(_places(shared), "places binary"))
    classes = seed(places, words, shared)
    pair = sweep(places, words, shared, classes)
    end = counts.where(F.col("h") == int(END)).count()
    return Model(words, pair, total.n or 0, total.v, total.v - end - len(words.h)), counts


def score_lm(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", head: int = HEAD) -> DataFrame:
    """One row per row of ``docs``: id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    model, counts = fit(docs.where(~held_out(id_col)), text_col, head)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("t"))
    kind = dict(rows.dtypes)["_id"]
    scored = stage(rows.mapInArrow(_score(shared), f"uid long, _id {kind}, n_tokens long, known long, base double, score double, rare array<long>, n_rare long"))
    left = scored.agg(F.sum("n_rare")).first()[0] or 0
    buckets = max(1, -(-(left + model.rare_words) // BUCKET))
    words = scored.where("n_rare > 0").select("uid", "rare").mapInArrow(_rare_words(buckets), "k long, a binary, b binary")
    known = counts.select("h", "c").mapInArrow(_rare_counts(shared, buckets), "k long, a binary, b binary")
    sums = words.groupBy("k").cogroup(known.groupBy("k")).applyInArrow(_meet, "k long, a binary, b binary, c binary")
    texts = scored.select(F.shiftright("uid", 33).alias("k"), "uid", "_id", "n_tokens", "known", "base", "score")
    out = texts.groupBy("k").cogroup(sums.groupBy("k")).applyInArrow(_add_rare, f"_id {kind}, n_tokens long, n_known long, base_score double, score double")
    return out.select(F.col("_id").alias(id_col), held_out("_id").alias("held_out"), "n_tokens", "n_known", F.lit(int(model.total)).cast("long").alias("train_tokens"), "base_score", "score")


@query("op2_brown_lm")
def op2_brown_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = score_lm(table(spark, sf_dir, "documents"))
    return out.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))
