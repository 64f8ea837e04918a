"""SimHash near-duplicate detection with deletion-variant signatures.

A 64-bit fingerprint is cut into two 32-bit segments. Of two fingerprints that differ in at most three
bits, one segment differs in at most one, so both share one of that segment's 32 one-wildcard variants
(the wildcard's position and the segment with this bit cleared). Variants are joined by equality: they
are dealt out by variant and sorted, so that a bucket's fingerprints meet in one task, where the distance
on all 64 bits is verified. Exact copies share a fingerprint and are collapsed before that step.

A bucket emits a spanning forest of its links and never all its pairs. A large bucket is indexed once
more, by the one-wildcard variants of the other segment's halves, which bounds a sub-bucket to the 2^18
values its free bits allow; no link is lost.

``keep_one``, the pipeline's near-dedup, has a rule of its own: sets of five-word shingles with a Jaccard
similarity of 0.8 or more. Its fingerprints are of the sets and have 128 bits in eight 16-bit segments: of two that
differ in at most fifteen bits, one segment differs in at most one. Texts at 0.8 differ in about nineteen bits
of 128 and unrelated ones in 64, so each pair that meets in a variant and differs in at most 32 is a
candidate (a pair at 0.8 meets with a probability of 0.93, one at 0.9 with 0.99), and the texts decide. No radius
takes in every similar pair: ``similar`` adds the links between texts that fingerprints have left apart.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planloom.llm.common import map_batches, materialize, row_keys, texts_in
from planloom.llm.components import components
from planloom.llm.similar import runs, similar_rows

MAX_DISTANCE, SEGMENTS, SEED, WORDS = 3, 2, 42, 3
#: Of the 128 bits of a set of shingles, for the pipeline's near-dedup.
SET_DISTANCE, SET_SEGMENTS = 32, 8
#: Buckets up to this size are compared by shifts of the sorted column, larger ones by a search from each member.
SHIFTED = 12
#: Buckets over this size are indexed a second time.
REINDEXED = 2048


def set_print(hashes: np.ndarray) -> tuple[int, int]:
    """SimHash of a set of hashes in two 64-bit words; the second is of the hashes mixed once more."""
    counts = np.zeros(128, np.int64)
    for start in range(0, len(hashes), 1 << 14):
        some = hashes[start : start + (1 << 14)]
        more = (some ^ (some >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        more = (more ^ (more >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
        both = np.stack([some, more ^ (more >> np.uint64(33))], axis=1)
        counts += np.unpackbits(both.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint16)
    first, second = np.packbits(counts * 2 > len(hashes), bitorder="little").view(np.uint64).tolist()
    return first, second


def fingerprint(text: bytes, words: int = WORDS) -> int:
    """SimHash of the word shingles of a UTF-8 text: A-Z lowered, ASCII white space, repeats included."""
    parts = text.lower().split()
    if not parts:
        return 0
    grams = list(map(b" ".join, zip(*(parts[i:] for i in range(words))))) or [b" ".join(parts)]
    counts = np.zeros(64, np.int64)
    for start in range(0, len(grams), 1 << 15):
        some = grams[start : start + (1 << 15)]
        hashes = np.fromiter((xxhash.xxh64_intdigest(g, SEED) for g in some), np.uint64, len(some))
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(grams), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(``id_col``, fp long) for every row; a null or blank text has fingerprint 0."""

    def run(batches):
        for batch in batches:
            values = np.fromiter(map(fingerprint, texts_in(batch.column(1))), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values.view(np.int64))], names=[id_col, "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return map_batches(docs.select(id_col, F.col(text_col).cast("binary")), run, f"`{id_col}` {kind}, fp bigint")


def variants(prints: DataFrame, segments: int = SEGMENTS, words: tuple[str, ...] = ("fp",)) -> DataFrame:
    """(key, all columns): the one-wildcard segment variants, as many as bits, of each fingerprint of 64-bit ``words``."""
    width = 64 * len(words) // segments
    word = " ".join(f"WHEN at < {64 * (i + 1)} THEN {w}" for i, w in enumerate(words))
    segment = F.expr(f"shiftrightunsigned(CASE {word} END, (at - at % {width}) % 64) & {(1 << width) - 1}")
    return prints.select("*", F.explode(F.expr(f"sequence(0, {64 * len(words) - 1})")).alias("at")).select(
        F.expr("shiftleft(CAST(at AS BIGINT), 32)").bitwiseOR(segment.bitwiseAND(F.expr(f"~shiftleft(1L, at % {width})"))).alias("key"), *prints.columns
    )


def _near(a: np.ndarray, b, most: int = MAX_DISTANCE) -> np.ndarray:
    """Whether fingerprints differ in at most ``most`` bits; those of several words have a row each."""
    both = a ^ b
    if both.ndim == 1:
        return np.bitwise_count(both) <= most
    return sum(np.bitwise_count(both[..., word]) for word in range(both.shape[-1])) <= most


def _search(values: np.ndarray, names: np.ndarray | None = None, most: int = MAX_DISTANCE) -> list[tuple[np.ndarray, np.ndarray]]:
    """Spanning forest of one bucket, of direct links: each search step removes what it reaches from the open set."""
    names = values if names is None else names
    open_, called, found = values, names, []
    while len(open_) > 1:
        queue = [(open_[0], called[0])]
        open_, called = open_[1:], called[1:]
        while queue and len(open_):
            value, name = queue.pop()
            near = _near(open_, value, most)
            if near.any():
                reached = called[near]
                found.append((np.full(len(reached), name), reached))
                queue.extend(zip(open_[near], reached))
                open_, called = open_[~near], called[~near]
    return found


def _not_alone(values: np.ndarray, most: int) -> np.ndarray:
    """Which of a bucket's fingerprints of several words are near any other: few where short segments bring unrelated texts together."""
    columns = np.ascontiguousarray(values.T)
    found = []
    for at in range(0, len(values), 64):
        far = sum(np.bitwise_count(c[at : at + 64, None] ^ c) for c in columns)
        found.append(np.count_nonzero(far <= most, axis=1) > 1)
    return np.concatenate(found)


def _groups(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return starts, np.diff(np.append(starts, len(keys)))


def _rest(values: np.ndarray, place: int, width: int, parts: int) -> np.ndarray:
    """(row, part): the bits of each fingerprint without those of one segment, in equal parts."""
    out = []
    for start in range(0, len(values), 1 << 14):
        some = values[start : start + (1 << 14)]
        bits = np.unpackbits(some.view(np.uint8).reshape(len(some), -1), axis=1, bitorder="little")
        bits = np.delete(bits, np.s_[place : place + width], axis=1).reshape(len(some), parts, -1)
        out.append((bits @ (1 << np.arange(bits.shape[2]))).astype(np.uint64))
    return np.concatenate(out)


def _links(keys: np.ndarray, values: np.ndarray, names: np.ndarray | None = None, segments: int = SEGMENTS, most: int = MAX_DISTANCE, reindex: bool = True) -> list[tuple[np.ndarray, np.ndarray]]:
    """Direct links within runs of equal keys, as names; without these, ``values`` are their own and distinct within a run."""
    if not len(keys):
        return []
    names = values if names is None else names
    starts, sizes = _groups(keys)
    found = []
    small = np.repeat(sizes <= SHIFTED, sizes)
    k, v, c = keys[small], values[small], names[small]
    for lag in range(1, SHIFTED):
        hit = np.flatnonzero(k[lag:] == k[:-lag])
        if not len(hit):
            break
        hit = hit[_near(v[hit + lag], v[hit], most)]
        found.append((c[hit], c[hit + lag]))
    width = values[0].nbytes * 8 // segments
    for start, size in zip(starts[sizes > SHIFTED], sizes[sizes > SHIFTED]):
        bucket, called = values[start : start + size], names[start : start + size]
        if size <= REINDEXED or not reindex:
            near = _not_alone(bucket, most) if values.ndim > 1 and size <= REINDEXED else slice(None)
            found += _search(bucket[near], called[near], most)
            continue
        # the bits of the other segments, in as many parts as there are segments: again at most one in some part
        rest = _rest(bucket, int(keys[start] >> 32) // width * width, width, segments)
        for part in rest.T:
            for bit in range(width - width // segments):
                masked = part & ~np.uint64(1 << bit)
                order = np.argsort(masked, kind="stable")
                found += _links(masked[order], bucket[order], called[order], segments, most, reindex=False)
    return found


def _forest(found: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """(smallest member, member) of the components that the links of one batch make."""
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    ends = np.concatenate([np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])]).view(np.int64)
    nodes, place = np.unique(ends, return_inverse=True)
    a, b = place[: len(place) // 2], place[len(place) // 2 :]
    label = np.arange(len(nodes))
    while True:
        low, before = np.minimum(label[a], label[b]), label.copy()
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        label = label[label]
        if np.array_equal(label, before):
            break
    child = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[label[child]], nodes[child]


def links(prints: DataFrame) -> DataFrame:
    """(src, dst) with src < dst: a spanning forest of the links between the distinct fingerprints ``fp``."""

    def run(batches):
        held: list[tuple[np.ndarray, np.ndarray]] = []
        rows = 0

        def out(keys, values):
            src, dst = _forest(_links(keys, values))
            return pa.RecordBatch.from_arrays([pa.array(src), pa.array(dst)], names=["src", "dst"])

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)))
            rows += batch.num_rows
            if rows < 1 << 17 or held[-1][0][-1] == held[0][0][0]:  # few rows, or one bucket so far
                continue
            keys, values = (np.concatenate(x) for x in zip(*held))
            cut = int(np.searchsorted(keys, keys[-1]))  # the last bucket may go on
            if cut:
                yield out(keys[:cut], values[:cut])
            held, rows = [(keys[cut:], values[cut:])], 0
        if held:
            yield out(*(np.concatenate(x) for x in zip(*held)))

    dealt = variants(prints).repartition("key").sortWithinPartitions("key")
    return map_batches(dealt, run, "src bigint, dst bigint").distinct()


def close_sets(prints: DataFrame) -> DataFrame:
    """(a, b) with a < b: candidates among ``class`` with fingerprints (``fp``, ``fp2``); rows are distinct.

    They hold all pairs with at most fifteen differing bits, and others up to ``SET_DISTANCE``; of a bucket of more
    than a few, a spanning forest of such pairs.
    """

    def run(batches):
        for keys, first, second, names in runs(batches):
            found = _links(keys, np.stack([first, second], axis=1).view(np.uint64), names, SET_SEGMENTS, SET_DISTANCE)
            if not found:
                continue
            a, b = np.sort(np.stack([np.concatenate(x) for x in zip(*found)]), axis=0)
            order = np.lexsort((b, a))
            a, b = a[order], b[order]
            new = np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))[: len(a)]
            yield pa.RecordBatch.from_arrays([pa.array(a[new]), pa.array(b[new])], names=["a", "b"])

    dealt = variants(prints.select("fp", "fp2", "class"), SET_SEGMENTS, ("fp", "fp2")).repartition("key").sortWithinPartitions("key", "class")
    return map_batches(dealt, run, "a bigint, b bigint").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(``id_col``, fingerprint, component_id) for every row of ``docs``.

    Rows whose fingerprints differ in at most three bits are linked; ``component_id`` is the smallest
    id that links reach. Null, empty and blank texts have fingerprint zero and link like any other.
    Repeated rows stay repeated and fall into one component. A null id is never a component's name
    unless all ids of the component are null. Other columns are ignored. An empty table gives no rows.
    """
    prints = materialize(fingerprints(docs, id_col, text_col).withColumnRenamed(id_col, "id"), "prints")
    classes = prints.groupBy("fp").agg(F.min("id").alias("first_id"))
    roots = components(links(classes.select("fp")))
    rooted = classes.join(roots, classes.fp == roots.node, "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    rooted = materialize(rooted, "roots")
    named = rooted.join(rooted.groupBy("root").agg(F.min("first_id").alias("component_id")), "root").select("fp", "component_id")
    return prints.join(named, "fp").select(F.col("id").alias(id_col), F.expr("lower(lpad(hex(fp), 16, '0'))").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of each component of rows whose texts ``similar.similar_rows`` links, the row with the smallest id, in whole.

    Five-word shingles and a Jaccard similarity of 0.8 or more, where ``near_duplicates`` (op3_simhash) has
    three bits of a fingerprint of three-word shingles. Links come from the fingerprints of the sets first
    (``close_sets``), then from an exact join of what these leave apart. Rows are told apart by two hashes of id and text, so of
    repeated rows one stays; a row without an id stays only if its component has no row with one. Null, empty
    and blank texts are one component. Other columns may have any name. An empty table gives no rows.
    ``docs`` is read several times and must give the same rows each time: a table, not a sample.
    """
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    keyed = docs.select(*row_keys(id_col, text_col), F.col(id_col).alias("id"), F.col(text_col).alias("text"), whole.alias("whole"))
    roots = similar_rows(keyed.select("k1", "k2", F.col("text").cast("binary").alias("text")), set_print, close_sets)
    ids = keyed.groupBy("k1", "k2").agg(F.min("id").alias("id"), F.count("*").alias("n"))
    kept = roots.distinct().join(ids, ["k1", "k2"]).groupBy("root").agg(F.min(F.struct(F.col("id").isNull(), "id", "k1", "k2", "n")).alias("least")).select("least.k1", "least.k2", "least.n")
    kept = materialize(kept, "kept")
    many = kept.where("n > 1")
    out = keyed.join(kept.where("n = 1"), ["k1", "k2"], "left_semi").select("whole")
    if not many.isEmpty():
        out = out.unionByName(keyed.join(many, ["k1", "k2"], "left_semi").groupBy("k1", "k2").agg(F.first("whole").alias("whole")).select("whole"))
    return out.select("whole.*")
