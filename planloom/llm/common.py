"""Helpers that the text operators share: word patterns, Arrow batches, and the engine's work tables."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import shutil
import tempfile
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from planloom.sources.work import discard, shared_dir, work_path
from planloom.sources.work import written as materialize

__all__ = ["SPACE", "ascii_lower", "discard", "kept", "map_batches", "materialize", "row_keys", "settled", "shared_dir", "ship", "space_words", "split_words", "texts_in", "with_places", "work_path"]

#: ASCII white space, as a Java character class body.
SPACE = r"\x20\x09-\x0D"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. ``lower`` has a fast path for ASCII; other texts need ``translate``."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def split_words(text: Column, separators: str) -> Column:
    """Array of the maximal runs of characters outside the Java class body ``separators``."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), f"[{separators}]+"), lambda w: w != "")


def space_words(text: Column) -> Column:
    """Array of the runs of characters other than ASCII white space; ``text`` must not be null."""
    trimmed = F.trim(text, F.lit(" \t\n\x0b\x0c\r"))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, f"[{SPACE}]+"))


def row_keys(id_col: str, text_col: str) -> tuple[Column, Column]:
    """``k1`` and ``k2``: 128 bits of hash of a row's id and text, nulls told apart from all else."""
    row_id, text = F.col(id_col), F.col(text_col)
    return F.xxhash64(text, row_id, text.isNull(), row_id.isNull()).alias("k1"), F.xxhash64(F.lit(1), row_id, text, text.isNull(), row_id.isNull()).alias("k2")


def with_places(docs: DataFrame) -> DataFrame:
    """(key, row): each row in whole and where it lies, as (hash of the file's name, row of the file).

    A plain scan is used as it is, so nothing is copied; anything else is written first and scanned from there.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    plain = docs._jdf.queryExecution().analyzed().getClass().getSimpleName() == "LogicalRelation" and docs.inputFiles() and "_metadata" not in docs.columns
    whole = docs if plain else materialize(docs.select(row), "rows")
    key = F.struct(F.xxhash64("_metadata.file_path").alias("f"), F.col("_metadata.row_index").alias("i")).alias("key")
    return whole.select(key, row if plain else "row")


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once, so that their Python workers can import it wherever they run."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    _shipped.add(context.applicationId)
    root = Path(__file__).resolve().parents[1]
    folder = tempfile.mkdtemp(prefix="planloom-code-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    out = Path(folder) / "planloom.zip"
    with zipfile.ZipFile(out, "w") as archive:
        for file in sorted(root.rglob("*.py")):
            archive.write(file, file.relative_to(root.parent))
    context.addPyFile(str(out))


_kept: dict[tuple, object] = {}


def kept(make: Callable, *args):
    """``make(*args)`` once for each Python worker, which keeps one such object until it runs a task without ``keeps``."""
    key = (make, *args)
    if key not in _kept:
        _forget()
        _kept[key] = make(*args)
    return _kept[key]


def _forget() -> None:
    """Workers outlive their stage, so what one operator keeps would add to the memory of all that follow."""
    if _kept:
        _kept.clear()
        gc.collect()
        with contextlib.suppress(OSError, AttributeError):  # not every C library has it
            ctypes.CDLL(None).malloc_trim(0)


def map_batches(df: DataFrame, function: Callable[[Iterator], Iterator], schema: str, keeps: bool = False) -> DataFrame:
    """``mapInArrow`` with batches small enough that very long texts fit in a Python worker, which frees them when a task ends.

    ``keeps``: ``function`` asks for something ``kept``; any other task lets go of it.
    """
    import pyarrow as pa

    def run(batches: Iterator) -> Iterator:
        if not keeps:
            _forget()
        yield from function(batches)
        pa.default_memory_pool().release_unused()

    ship(df.sparkSession)
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "4m")
    return df.mapInArrow(run, schema)


def texts_in(column, step: int = 64) -> Iterator[bytes]:
    """The values of a binary Arrow column, null as empty, a few at a time."""
    for start in range(0, len(column), step):
        for value in column.slice(start, step).to_pylist():
            yield value or b""


def settled(df: DataFrame) -> DataFrame:
    """``df`` behind a generator of one row each: a filter above stays above.

    Spark pushes filters below projections and puts the columns' expressions in their place; where columns
    build on each other, each would be made a great many times.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    return df.select(F.explode_outer(F.array(row)).alias("_r")).select(*[F.col("_r")[c].alias(c) for c in df.columns])
