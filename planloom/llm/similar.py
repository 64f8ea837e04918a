"""Exact similarity join of texts: sets of five-word shingles with a Jaccard similarity of 0.8 or more.

Equal sets collapse into a class first. The shingles of a set are put in one order for all sets, common ones
last; two similar sets then share a shingle within their first fifths (prefix filter), and the positions of the
first one they share bound their overlap (positional filter). Rows meet by such a shingle, and of the pairs that
pass both filters the whole texts are compared. Only texts that are in a pair move for that.

Before that come the pairs that an index of sketches of the sets finds (the pipeline's are SimHash fingerprints):
their texts are compared first, and the join compares only pairs that these links leave apart.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planloom.llm.common import discard, map_batches, materialize, texts_in
from planloom.llm.components import components

WORDS, SEED = 5, 42
#: Slots in which shingles are counted to order them, and how many travel as one row.
SLOTS, PART = 1 << 19, 1 << 12
#: Buckets up to this size give all their pairs, larger ones those of a few of their rows at a time.
ABREAST, PIVOTS = 12, 4
#: Bits of the mask that tells which rows are in no pair: its size is fixed, and it only ever lets too many through.
MASK = 1 << 26
#: Classes that a task remembers, and pairs of one text that go to one task (about).
SEEN, SHARE = 1 << 18, 4096


def shingles(text: bytes, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the word shingles of a UTF-8 text: A-Z lowered, ASCII white space; fewer words are one shingle."""
    parts = text.lower().split()
    if not parts:
        return np.empty(0, np.uint64)
    grams = {*map(b" ".join, zip(*(parts[i:] for i in range(words))))} or {b" ".join(parts)}
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(g, SEED) for g in grams), np.uint64, len(grams)))


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether the Jaccard similarity of two sets of distinct hashes is 0.8 or more; two empty sets are equal."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 5 * both >= 4 * (len(a) + len(b) - both)


def _class(hashes: np.ndarray) -> int:
    """The name of a set: 64 bits, so two different sets share one with a probability of 2^-64."""
    return xxhash.xxh64_intdigest(hashes.tobytes(), SEED + 1)


def _slots(hashes: np.ndarray) -> np.ndarray:
    return (hashes % np.uint64(SLOTS)).astype(np.int64)


class _Fresh:
    """Says of each class whether a task meets it first; what it forgets is only met again."""

    def __init__(self) -> None:
        self.seen: set[int] = set()

    def __call__(self, name: int) -> bool:
        if name in self.seen:
            return False
        if len(self.seen) >= SEEN:
            self.seen.clear()
        self.seen.add(name)
        return True


def _sets(texts: DataFrame, sketch: Callable[[np.ndarray], tuple[int, int]]) -> DataFrame:
    """(k1, k2, class, fp, fp2) of every row, and beside them, with a null class, each task's counts of shingles (part, counts).

    ``fp`` and ``fp2`` are the sketch of the set where a task meets its class first, else null.
    """

    def run(batches):
        fresh, counts, held, size = _Fresh(), np.zeros(SLOTS, np.int64), [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            names, prints = [], []
            for text in texts_in(batch.column(2)):
                hashes = shingles(text)
                names.append(_class(hashes))
                prints.append((None, None))
                if fresh(names[-1]):
                    prints[-1] = sketch(hashes)
                    held.append(_slots(hashes))
                    size += len(hashes)
                if size > 1 << 20:
                    counts += np.bincount(np.concatenate(held), minlength=SLOTS)
                    held, size = [], 0
            none = pa.nulls(len(names))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.array(names, np.uint64).view(np.int64)), *[pa.array(x, pa.uint64()).view(pa.int64()) for x in zip(*prints)], none.cast(pa.int32()), none.cast(pa.binary())], names=names_out)
        if held:
            counts += np.bincount(np.concatenate(held), minlength=SLOTS)
        small = np.minimum(counts, 0xFFFF).astype(np.uint16).reshape(-1, PART)
        parts = np.flatnonzero(small.any(axis=1))
        if len(parts):
            none = pa.nulls(len(parts), pa.int64())
            yield pa.RecordBatch.from_arrays([*[none] * 5, pa.array(parts, pa.int32()), pa.array([small[p].tobytes() for p in parts], pa.binary())], names=names_out)

    names_out = ["k1", "k2", "class", "fp", "fp2", "part", "counts"]
    return map_batches(texts.select("k1", "k2", "text"), run, "k1 bigint, k2 bigint, class bigint, fp bigint, fp2 bigint, part int, counts binary")


def _ranks(sets: DataFrame) -> np.ndarray:
    """By the slot of a shingle, how common the shingles in it are (logarithmic): ``SLOTS`` bytes.

    It only orders shingles, so that those of a common passage come last; any order finds the same pairs.
    """

    def total(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                sums[part] = sums.get(part, 0) + np.frombuffer(counts, np.uint16).astype(np.int64)
        ranks = {k: (4 * np.log2(v + 1.0)).astype(np.uint8).tobytes() for k, v in sums.items()}
        yield pa.RecordBatch.from_arrays([pa.array(list(ranks), pa.int32()), pa.array(list(ranks.values()), pa.binary())], names=["part", "ranks"])

    summed = map_batches(sets.where("part IS NOT NULL").select("part", "counts").repartition("part"), total, "part int, ranks binary")
    out = np.zeros(SLOTS, np.uint8)
    for part, ranks in summed.collect():  # SLOTS bytes in all
        out[part * PART : (part + 1) * PART] = np.frombuffer(ranks, np.uint8)
    return out


def _members(texts: DataFrame, ranks: np.ndarray) -> DataFrame:
    """(key, class, at): the first fifth and one of each set's shingles; ``at`` is the set's size * 2^32 + the position."""
    shared = texts.sparkSession.sparkContext.broadcast(ranks)

    def run(batches):
        fresh, top = _Fresh(), shared.value.astype(np.uint64) << np.uint64(56)

        def out(held):
            columns = [np.concatenate(x) for x in zip(*held)]
            return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in columns], names=["key", "class", "at"])

        for batch in batches:
            held, size = [], 0
            for text in texts_in(batch.column(0)):
                hashes = shingles(text)
                n, name = len(hashes), _class(hashes)
                if not n or not fresh(name):
                    continue
                # by rank, then hash: hashes come sorted, so a stable sort also decides what the lost bits leave open
                order = np.argsort(top[_slots(hashes)] | (hashes >> np.uint64(8)), kind="stable")
                first = hashes[order[: n - -(-4 * n // 5) + 1]]
                held.append((first, np.full(len(first), name, np.uint64), np.arange(len(first), dtype=np.uint64) + np.uint64(n << 32)))
                size += len(first)
                if size > 1 << 16:
                    yield out(held)
                    held, size = [], 0
            if held:
                yield out(held)

    return map_batches(texts.select("text"), run, "key bigint, class bigint, at bigint")


def runs(batches):
    """The columns of batches sorted by the first, in pieces that never part a run of equal first values."""
    held, rows = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append([c.to_numpy() for c in batch.columns])
        rows += batch.num_rows
        if rows < 1 << 17 or held[-1][0][-1] == held[0][0][0]:  # few rows, or one run so far
            continue
        columns = [np.concatenate(x) for x in zip(*held)]
        cut = int(np.searchsorted(columns[0], columns[0][-1]))
        if cut:
            yield [c[:cut] for c in columns]
        held, rows = [[c[cut:] for c in columns]], len(columns[0]) - cut
    if rows:
        yield [np.concatenate(x) for x in zip(*held)]


def _may_be_similar(a: np.ndarray, b) -> np.ndarray:
    """Of members of one bucket, by size and position: whether 0.8 is open if this is the first shingle they share."""
    n, m = a >> 32, b >> 32
    most = np.minimum(n - (a & 0xFFFFFFFF), m - (b & 0xFFFFFFFF))
    return 9 * most >= 4 * (n + m)


def _pairs(members: DataFrame, pivots: int) -> DataFrame:
    """From buckets of (key, class, at, root): pairs (a, b) to compare, and the members (key, class, at) not yet done, with a null ``a``.

    A bucket of up to ``ABREAST`` sets gives all pairs that are not in one component yet and pass the filters. A
    larger one gives those of its first ``pivots`` sets, which are then done; the others go on.
    """

    def run(batches):
        for keys, names, at, roots in runs(batches):
            new = np.concatenate(([True], (keys[1:] != keys[:-1]) | (names[1:] != names[:-1])))  # one class may come from several tasks
            keys, names, at, roots = keys[new], names[new], at[new], roots[new]
            starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
            counts = np.diff(np.append(starts, len(keys)))
            found, left = [np.empty((2, 0), np.int64)], [np.empty(0, np.int64)]
            small = np.repeat(counts <= ABREAST, counts)
            k, c, p, o = keys[small], names[small], at[small], roots[small]
            for lag in range(1, min(ABREAST, len(k))):
                hit = np.flatnonzero(k[lag:] == k[:-lag])
                hit = hit[(o[hit + lag] != o[hit]) & _may_be_similar(p[hit + lag], p[hit])]
                found.append(np.stack([c[hit], c[hit + lag]]))
            for start, count in zip(starts[counts > ABREAST], counts[counts > ABREAST]):
                c, p, o = (x[start : start + count] for x in (names, at, roots))
                if (o == o[0]).all():
                    continue
                for i in range(min(pivots, count - 1)):
                    hit = np.flatnonzero((o[i + 1 :] != o[i]) & _may_be_similar(p[i + 1 :], p[i])) + i + 1
                    found.append(np.stack([np.full(len(hit), c[i]), c[hit]]))
                if count - pivots > 1:
                    left.append(np.arange(start + pivots, start + count))
            a, b = np.sort(np.concatenate(found, axis=1), axis=0)
            order = np.lexsort((b, a))
            a, b = a[order], b[order]
            new = np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))[: len(a)]
            rest = np.concatenate(left)
            pairs = [pa.array(a[new]), pa.array(b[new]), *[pa.nulls(int(new.sum()), pa.int64())] * 3]
            others = [*[pa.nulls(len(rest), pa.int64())] * 2, *[pa.array(x[rest]) for x in (keys, names, at)]]
            for some in (pairs, others):
                yield pa.RecordBatch.from_arrays(some, names=["a", "b", "key", "class", "at"])

    dealt = members.select("key", "class", "at", "root").repartition("key").sortWithinPartitions("key", "class")
    return map_batches(dealt, run, "a bigint, b bigint, key bigint, class bigint, at bigint")


def _texts_of(pairs: DataFrame, texts: DataFrame, first: DataFrame) -> DataFrame:
    """(class, text) of the classes in ``pairs``: by a mask of fixed size within the scan, then exactly."""
    spark = texts.sparkSession
    wanted = materialize(pairs.select(F.explode(F.array("a", "b")).alias("class")).distinct().join(first, "class").select("class", "k.*"), "wanted")
    slot = F.pmod("k1", F.lit(MASK))
    words = wanted.groupBy(F.shiftright(slot, 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(pmod(k1, 64L) AS INT))")).alias("bits")).toArrow()  # MASK / 64 rows at most
    mask = np.zeros(MASK >> 6, np.uint64)
    mask[words.column(0).to_numpy()] = words.column(1).to_numpy().view(np.uint64)
    shared = spark.sparkContext.broadcast(mask)

    def run(batches):
        fresh = _Fresh()
        for batch in batches:
            key = batch.column(0).to_numpy()
            at = key.view(np.uint64) % np.uint64(MASK)
            keep = (shared.value[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)
            for i in np.flatnonzero(keep):
                keep[i] = fresh(int(key[i]))
            yield batch.filter(pa.array(keep))

    some = map_batches(texts.select("k1", "k2", "text"), run, "k1 bigint, k2 bigint, text binary")
    return materialize(some.dropDuplicates(["k1", "k2"]).join(wanted, ["k1", "k2"]).select("class", "text"), "texts")


@functools.lru_cache(maxsize=16)
def _shingles_again(text: bytes) -> np.ndarray:
    """``shingles`` for texts that come many times in a row."""
    return shingles(text)


def _similar(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(src, dst): the pairs whose texts are similar.

    Each pair brings one of its texts to the other, which comes once for every ``SHARE`` of its pairs or so.
    """

    def run(batches):
        mine = None
        for batch in batches:
            src, dst, keep = batch.column(0).to_pylist(), batch.column(1).to_pylist(), []
            for b, text in zip(dst, texts_in(batch.column(2), 8)):
                if b is None:
                    mine = shingles(text)
                keep.append(b is not None and similar(mine, _shingles_again(text)))
            keep = np.array(keep, bool)
            yield pa.RecordBatch.from_arrays([pa.array(np.array(src, np.int64)[keep]), pa.array([b for b, k in zip(dst, keep) if k], pa.int64())], names=["src", "dst"])

    shares = pairs.groupBy("a").agg(F.ceil(F.count("*") / SHARE).cast("int").alias("shares"))
    left = shares.join(texts.withColumnRenamed("class", "a"), "a").select("a", F.explode(F.expr("sequence(0, shares - 1)")).alias("share"), F.lit(None).cast("bigint").alias("b"), "text")
    right = pairs.join(shares, "a").join(texts.withColumnRenamed("class", "b"), "b").select("a", F.expr("CAST(pmod(xxhash64(b), shares) AS INT)").alias("share"), "b", "text")
    dealt = left.unionByName(right).repartition("a", "share").sortWithinPartitions("a", "share", F.col("b").asc_nulls_first())
    return map_batches(dealt.select("a", "b", "text"), run, "src bigint, dst bigint")


def _compared(pairs: DataFrame, texts: DataFrame, first: DataFrame) -> DataFrame:
    """(src, dst): the pairs of classes (a, b) whose texts are similar."""
    pairs = materialize(pairs, "pairs")
    of_pairs = _texts_of(pairs, texts, first)
    found = materialize(_similar(pairs, of_pairs), "similar")
    discard(pairs)
    discard(of_pairs)
    return found


def _apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs (a, b) whose ends are not in one component."""
    for end in ("a", "b"):
        pairs = pairs.join(roots.select(F.col("node").alias(end), F.col("root").alias(f"root_{end}")), end, "left")
    return pairs.where("coalesce(root_a, a) != coalesce(root_b, b)").select("a", "b")


def similar_rows(texts: DataFrame, sketch: Callable[[np.ndarray], tuple[int, int]], close: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(k1, k2, root) for every row of (``k1`` long, ``k2`` long, ``text`` binary): the name of its component.

    Rows are linked where the Jaccard similarity of their sets of five-word shingles is 0.8 or more (a text of
    fewer words is one shingle). ``sketch`` makes 128 bits of a set, and ``close`` candidates (a, b) of (class, fp, fp2);
    what they do not link is joined exactly. Candidates are complete and each link is verified. Large buckets are compared
    with a few of their rows at a time, and what this links is not compared again. ``k1`` and ``k2`` are hashes;
    rows with equal ones have equal texts. ``texts`` is read several times and must give the same rows each time.
    """
    sets = materialize(_sets(texts, sketch), "sets")
    rows = sets.where("class IS NOT NULL").select("k1", "k2", "class")
    first = rows.groupBy("class").agg(F.min(F.struct("k1", "k2")).alias("k"))
    edges = _compared(close(sets.where("fp IS NOT NULL").select("class", "fp", "fp2").distinct()), texts, first)
    roots = components(edges)
    members, pivots = _members(texts, _ranks(sets)).withColumn("root", F.col("class")), PIVOTS
    while True:
        met = materialize(_pairs(members, pivots), "met")
        pairs = met.where("a IS NOT NULL").select("a", "b").distinct()
        edges = edges.unionByName(_compared(_apart(pairs, roots), texts, first))
        roots = components(edges)
        rest = met.where("key IS NOT NULL").select("key", "class", "at")
        if rest.isEmpty():
            break
        members = rest.join(roots.withColumnRenamed("node", "class"), "class", "left").select("key", "class", "at", F.coalesce("root", "class").alias("root"))
        pivots *= 4
    return rows.join(roots.withColumnRenamed("node", "class"), "class", "left").select("k1", "k2", F.coalesce("root", "class").alias("root"))
