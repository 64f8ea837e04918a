"""Benchmark decontamination with DataFrame functions only.

The benchmark's normalised word windows form a hash set. Every position of every document is tested
against it inside the scan, and only those that hit leave it; they go with their words and are joined with the
windows themselves, which verifies each hit. Up to ``LISTED_WINDOWS`` windows the set is part of the plan and the
verifying join is a broadcast. Beyond that it is a broadcast table of hashes, or several of ``BROADCAST_HASHES``
at most with a scan each, and the hits are shuffled: positions that miss never are.

Rows are told apart by two hashes of id and text (``row_keys``): rows equal in both have equal results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planloom.llm.common import ascii_lower, row_keys, split_words

WINDOW = 10
#: Java class body of the characters between words, once A-Z are lowered.
SEPARATORS = r"\x00-\x2F\x3A-\x60\x7B-\x7F"
#: The windows stand in the plan up to this number, and while they name so many items each on average.
LISTED_WINDOWS, ITEMS_A_WINDOW = 100_000, 10
#: Hashes in one broadcast table (8 bytes each), and positions of a document that are looked at together.
BROADCAST_HASHES, CHUNK = 16_000_000, 4096


def words(text: Column) -> Column:
    return split_words(ascii_lower(text), SEPARATORS)


def _gram(at: str, size: int, array: str = "words") -> list[str]:
    return [f"{array}[{at} + {k}]" for k in range(size)]


def benchmark_windows(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(gram, size, h, items): the distinct windows of the items, with the ids of the items that hold them."""
    items = benchmark.select(F.col(id_col).alias("item"), words(F.col(text_col)).alias("words")).where("size(words) > 0")
    items = items.withColumn("size", F.least(F.size("words"), F.lit(window)))
    items = items.select("item", "words", "size", F.explode(F.expr("sequence(0, size(words) - size)")).alias("at"))
    grams = items.select("item", "size", F.expr("slice(words, at + 1, size)").alias("gram"))
    return grams.groupBy("gram", "size").agg(F.array_sort(F.collect_set(F.col("item").cast("string"))).alias("items")).withColumn("h", F.xxhash64("gram"))


def _listed_positions(size: int, hashes: list[int]) -> Column:
    """(pos, size, gram) of the windows of a document whose hash is one of ``hashes``."""
    listed = ", ".join(f"{h}L" if h >= 0 else f"({h}L)" for h in hashes).replace("(-9223372036854775808L)", "bigint(-9223372036854775808)")
    every = f"if(size(words) >= {size}, sequence(0, size(words) - {size}), array())"
    every = f"filter({every}, p -> xxhash64({', '.join(_gram('p', size))}) IN ({listed}))"
    return F.expr(f"transform({every}, p -> struct(p AS pos, {size} AS size, array({', '.join(_gram('p', size))}) AS gram))")


def _joined_positions(base: DataFrame, windows: DataFrame, size: int, parts: int) -> DataFrame:
    """(k1, k2, pos, size, gram): the same for one size of window, by ``parts`` broadcast tables of hashes.

    Documents are cut into overlapping chunks first, so that no array holds the windows of a whole text.
    """
    starts = F.expr(f"sequence(0, size(words) - {size}, {CHUNK})")
    chunks = base.where(F.size("words") >= size).select("k1", "k2", "words", starts.alias("starts"))
    chunks = chunks.select("k1", "k2", F.explode(F.expr(f"transform(starts, s -> struct(s AS start, slice(words, s + 1, {CHUNK + size - 1}) AS words))")).alias("c")).select("k1", "k2", "c.*")
    every = F.expr(f"transform(sequence(0, size(words) - {size}), p -> struct(start + p AS pos, xxhash64({', '.join(_gram('p', size))}) AS h, slice(words, p + 1, {size}) AS gram))")
    rows = chunks.select("k1", "k2", F.explode(every).alias("w")).select("k1", "k2", "w.*")
    hashes = windows.where(F.col("size") == size).select(F.expr(f"xxhash64({', '.join(_gram('0', size, 'gram'))})").alias("h")).distinct()
    found = None
    for part in range(parts):
        hit = rows.join(F.broadcast(hashes.where(F.pmod("h", F.lit(parts)) == part)), "h", "left_semi")
        found = hit if found is None else found.unionByName(hit)
    return found.select("k1", "k2", "pos", F.lit(size).alias("size"), "gram")


def find_hits(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, listed_windows: int = LISTED_WINDOWS, broadcast_hashes: int = BROADCAST_HASHES) -> DataFrame:
    """(k1, k2, id, n_words, hits, items): for every row, its keys, the verified hits (pos, size) and the item ids."""
    windows = benchmark_windows(benchmark, item_col, item_text_col, window)
    listed = windows.select("size", "h", F.size("items").alias("n")).limit(listed_windows + 1).collect()  # bounded by listed_windows
    base = docs.select(*row_keys(id_col, text_col), F.col(id_col).alias("id"), words(F.col(text_col)).alias("words"))
    known = windows.select(F.col("gram").alias("known"), F.col("size").alias("known_size"), "items")
    hit = F.when(F.col("known").isNotNull(), F.struct("pos", "size"))
    found = (F.collect_list(hit).alias("hits"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    if len(listed) <= listed_windows and sum(r["n"] for r in listed) <= ITEMS_A_WINDOW * listed_windows:
        by_size: dict[int, set[int]] = {}
        for size, h, _ in listed:
            by_size.setdefault(size, set()).add(h)
        parts = [_listed_positions(size, sorted(hashes)) for size, hashes in sorted(by_size.items())]
        near = F.concat(*parts) if len(parts) > 1 else parts[0] if parts else F.expr("CAST(array() AS ARRAY<STRUCT<pos: INT, size: INT, gram: ARRAY<STRING>>>)")
        near = base.select("k1", "k2", "id", F.monotonically_increasing_id().alias("row"), F.size("words").cast("long").alias("n_words"), near.alias("near"))
        near = near.select("k1", "k2", "id", "row", "n_words", F.explode_outer("near").alias("w")).select("k1", "k2", "id", "row", "n_words", "w.*")
        joined = near.join(F.broadcast(known), F.col("gram") == F.col("known"), "left")
        return joined.groupBy("row", "k1", "k2", "id").agg(F.first("n_words").alias("n_words"), *found).drop("row")
    sizes = {r["size"]: r["count"] for r in windows.groupBy("size").count().collect()}  # at most `window` of them
    near = None
    for size, count in sorted(sizes.items()):
        some = _joined_positions(base, windows, size, -(-count // broadcast_hashes))
        near = some if near is None else near.unionByName(some)
    hits = near.distinct().join(known, F.col("gram") == F.col("known")).groupBy("k1", "k2").agg(*found)
    none = (F.coalesce("hits", F.expr("CAST(array() AS ARRAY<STRUCT<pos: INT, size: INT>>)")).alias("hits"), F.coalesce("items", F.expr("CAST(array() AS ARRAY<STRING>)")).alias("items"))
    return base.select("k1", "k2", "id", F.size("words").cast("long").alias("n_words")).join(hits, ["k1", "k2"], "left").select("k1", "k2", "id", "n_words", *none)


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **columns) -> DataFrame:
    """(``id_col``, n_words, n_hit, n_items, items, items_sha256, contaminated) for every row of ``docs``.

    A word inside any occurrence of a benchmark window is hit. Null and empty texts have no words.
    Items without words, and an empty benchmark, hit nothing. Repeated rows give repeated results.
    Other columns are ignored; an empty table gives no rows.
    """
    return _judged(find_hits(docs, benchmark, id_col, **columns)).select(F.col("id").alias(id_col), "n_words", "n_hit", "n_items", "items", "items_sha256", "contaminated")


def _places() -> Column:
    """The places of all hit words, each once."""
    return F.array_distinct(F.flatten(F.transform("hits", lambda h: F.sequence(h["pos"], h["pos"] + h["size"] - 1))))


def _judged(found: DataFrame) -> DataFrame:
    covered = F.size(_places())
    n_hit = F.when(F.size("hits") == 0, F.lit(0)).otherwise(covered).cast("long")
    return found.select(
        "k1", "k2", "id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), "items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated")
    )


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(k1, k2, whole): the rows with their keys; other columns may have any name."""
    return docs.select(*row_keys(id_col, text_col), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole"))


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **columns) -> DataFrame:
    """The rows of ``docs`` whose own text is not contaminated, whatever their id: ids may be null or repeated.

    Null and empty texts stay. ``docs`` is read twice and must give the same rows each time. An empty table gives no rows.
    """
    bad = _judged(find_hits(docs, benchmark, id_col, text_col, **columns)).where("contaminated").select("k1", "k2")
    return _keyed(docs, id_col, text_col).join(bad, ["k1", "k2"], "left_anti").select("whole.*")


def remove_spans(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **columns) -> DataFrame:
    """``docs`` with the hit words taken out of the texts that have any, and those texts' white space collapsed.

    Words are cut from the original text: what stands between them, and the case of the rest, stays. Each row loses
    what its own text has in common with the benchmark: ids may be null or repeated. Null and empty texts stay as they are.
    """
    lost = find_hits(docs, benchmark, id_col, text_col, **columns).where("size(hits) > 0").groupBy("k1", "k2").agg(F.first("hits").alias("hits")).select("k1", "k2", _places().alias("lost"))
    run = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
    pieces = F.when(F.col("lost").isNotNull(), F.regexp_extract_all(F.col("whole")[text_col], F.lit(f"({run}+|[{run[2:]}+)"), F.lit(1)))
    marked = _keyed(docs, id_col, text_col).join(lost, ["k1", "k2"], "left").withColumn("pieces", pieces)
    # Words and what stands between them alternate: piece i is word (i - first) / 2 of the text.
    first = F.when(F.get("pieces", F.lit(0)).rlike(run), 0).otherwise(1)
    left = F.filter("pieces", lambda x, i: ~(((i - first) % 2 == 0) & F.array_contains("lost", F.floor((i - first) / 2).cast("int"))))
    text = F.when(F.col("lost").isNull(), F.col("whole")[text_col]).otherwise(F.trim(F.regexp_replace(F.array_join(left, ""), r"[\x20\x09-\x0D]+", " ")))
    return marked.select(*[text.alias(c) if c == text_col else F.col("whole")[c].alias(c) for c in docs.columns])
