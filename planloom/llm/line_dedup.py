"""Line de-duplication across documents.

Every line is normalised and hashed to 128 bits; the distinct (line hash, document) rows are written once
and documents are counted per hash with map-side partial aggregation, so a line that a third of all
documents share is only a few partial counts. Lines over the threshold are joined back by hash (a skewed
join, which adaptive execution splits) and gathered per document as the hashes it loses; the text is
then reassembled in place, without ever moving single lines' texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planloom.llm.common import map_batches, materialize, texts_in

BLANK = b" \t\n\x0b\x0c\r"
MIN_CHARS, MIN_DOCS = 20, 3


def line_hash(line: bytes, min_chars: int = MIN_CHARS) -> bytes:
    """128-bit hash of a line's key, or nothing if the key has fewer than ``min_chars`` code points."""
    key = line.strip(BLANK).lower()
    if len(key) < min_chars or len(key) < 4 * min_chars and len(key.decode("utf-8", "replace")) < min_chars:
        return b""
    return xxhash.xxh3_128_digest(key)


def line_hashes(docs: DataFrame, min_chars: int = MIN_CHARS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, a, b): the distinct line hashes of each row, as two longs."""

    def run(batches):
        for batch in batches:
            found, sizes = [], []
            for text in texts_in(batch.column(1)):
                mine = {line_hash(line, min_chars) for line in text.split(b"\n")} - {b""}
                found.append(b"".join(mine))
                sizes.append(len(mine))
            halves = np.frombuffer(b"".join(found), "<i8").reshape(-1, 2)
            ids = batch.column(0).take(pa.array(np.repeat(np.arange(len(sizes)), sizes)))
            yield pa.RecordBatch.from_arrays([ids, pa.array(np.ascontiguousarray(halves[:, 0])), pa.array(np.ascontiguousarray(halves[:, 1]))], names=["id", "a", "b"])

    kind = docs.schema[id_col].dataType.simpleString()
    return map_batches(docs.select(F.col(id_col), F.col(text_col).cast("binary")), run, f"id {kind}, a bigint, b bigint")


def dedup_lines(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(``id_col``, text, n_lines, n_dropped, kept_sha256) for every row of ``docs``.

    A line's key is the line stripped of ASCII white space with A-Z lowered. Keys of at least
    ``min_chars`` code points in at least ``min_docs`` different ids lose all their lines except in the
    largest id that holds them. Null and empty texts have one empty line. Rows that repeat an id count
    once and are treated alike. Rows with a null id are not counted and lose no line. Other columns are
    ignored; an empty table gives no rows.
    """
    lines = materialize(line_hashes(docs, min_chars, id_col, text_col).where("id IS NOT NULL"), "lines")
    shared = lines.groupBy("a", "b").agg(F.countDistinct("id").alias("docs"), F.max("id").alias("last")).where(F.col("docs") >= min_docs)
    # Written, so that the join has a plain exchange on either side, whose skewed partitions Spark splits.
    shared = materialize(shared.select("a", "b", "last"), "shared")
    losses = lines.join(shared, ["a", "b"]).where("id < last").groupBy("id").agg(F.collect_set(F.struct("a", "b")).alias("lost"))
    losses = losses.select(F.col("id").alias("_id"), F.transform("lost", lambda x: x["a"]).alias("lost_a"), F.transform("lost", lambda x: x["b"]).alias("lost_b"))
    ready = docs.select(F.col(id_col), F.col(text_col).cast("binary").alias("text")).join(losses.hint("shuffle_hash"), F.col(id_col) == F.col("_id"), "left").drop("_id")

    def lost_of(column_a, column_b) -> Iterator[set[bytes]]:
        for a, b in zip(column_a, column_b):
            if not a.is_valid:
                yield set()
                continue
            pairs = np.stack([a.values.to_numpy(), b.values.to_numpy()], axis=1).astype("<i8").tobytes()
            yield {pairs[i : i + 16] for i in range(0, len(pairs), 16)}

    def run(batches):
        for batch in batches:
            texts, totals, dropped, sums = [], [], [], []
            for text, lost in zip(texts_in(batch.column(1)), lost_of(batch.column(2), batch.column(3))):
                parts = text.split(b"\n")
                kept = [x for x in parts if line_hash(x, min_chars) not in lost] if lost else parts
                texts.append(b"\n".join(kept))
                totals.append(len(parts))
                dropped.append(len(parts) - len(kept))
                sums.append(hashlib.sha256(texts[-1]).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.binary()).view(pa.string()), pa.array(totals, pa.int64()), pa.array(dropped, pa.int64()), pa.array(sums, pa.string())], names=[id_col, "text", "n_lines", "n_dropped", "kept_sha256"])

    kind = docs.schema[id_col].dataType.simpleString()
    return map_batches(ready, run, f"`{id_col}` {kind}, text string, n_lines bigint, n_dropped bigint, kept_sha256 string")
