"""Mixing sources to target weights with a temperature.

Token shares p of the sources are raised to an exponent a and normalised. a = 1 keeps the corpus as it
is, a = 0 gives all sources the same weight. The exponent is bisected (several points a round, each
round one aggregate over the sources) for the flattest mix within the repetition limit, or for a target
entropy. Weights are realised as block permutations: each source is dealt into hashed blocks, each pass is a
permutation of them of its own, and a source gets as many whole passes and blocks of one more as its budget
of tokens holds. A block's place in its source's passes, as a share of them, is its place in the mix, so each
stretch of the mix holds the sources at their weights. No step gathers a source in one task: sums per block are
partial aggregates, and only the table of blocks is ordered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from planloom.llm.common import SPACE, materialize

BLOCKS, MAX_PASSES, POINTS, ROUNDS = 1024, 4.0, 16, 6
#: The table of blocks (sources times BLOCKS rows) is broadcast up to this size and shuffled beyond.
BROADCAST_ROWS = 100_000


def count_tokens(text: Column) -> Column:
    """Tokens of a text for the budget: its white-space separated words, at least one a document."""
    return F.greatest(F.regexp_count(F.coalesce(text, F.lit("")), F.lit(f"[^{SPACE}]+")).cast("long"), F.lit(1).cast("long"))


def exponent_for(shares: DataFrame, max_passes: float = MAX_PASSES, entropy: float | None = None) -> float:
    """The exponent in [0, 1] for the table (share): the least whose most repeated source has at most
    ``max_passes`` passes, and, if ``entropy`` is given (0 to 1, of the greatest possible), the greatest
    whose entropy reaches it, as far as the repetition limit allows.
    """
    facts = shares.agg(F.max("share"), F.min("share"), F.count("*")).first()
    if not facts[2] or facts[0] == facts[1]:
        return 1.0
    largest, smallest, n = facts

    def least(holds) -> float:
        """The least exponent that holds, if all above it do."""
        low, high = 0.0, 1.0
        for _ in range(ROUNDS):
            points = [low + (high - low) * k / POINTS for k in range(POINTS + 1)]
            good = holds(points)
            k = next((k for k, x in enumerate(good) if x), POINTS)
            low, high = points[max(0, k - 1)], points[k]
        return high

    limit = least(lambda points: [(smallest / largest) ** (a - 1) <= max_passes for a in points])
    if entropy is None:
        return limit
    share = F.col("share") / F.lit(largest)

    def short(points):
        sums = [c for k, a in enumerate(points) for c in (F.sum(F.pow(share, F.lit(a))).alias(f"z{k}"), F.sum(F.pow(share, F.lit(a)) * F.log(share)).alias(f"l{k}"))]
        r = shares.agg(*sums).first()
        from math import log

        return [log(r[f"z{k}"]) - a * r[f"l{k}"] / r[f"z{k}"] < entropy * log(n) for k, a in enumerate(points)]

    return max(limit, least(short))


def block_copies(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", budget: int | None = None, max_passes: float = MAX_PASSES, entropy: float | None = None, blocks: int = BLOCKS, seed: int = 17) -> DataFrame:
    """(source, block, share, weight, passes, copies, turns): how often each block of each source is taken, and where.

    One row for each source and block of it that has rows; ``blocks`` bounds them for each source. ``turns`` are
    the stretches (start, end) of the mix, from 0 to 1, that the block's copies fill, in order.
    """
    sums = _placed(docs, id_col, source_col, blocks, seed).groupBy("source", "block").agg(F.sum(count_tokens(F.col(text_col))).alias("tokens"))
    sums = materialize(sums, "blocks")
    totals = sums.groupBy("source").agg(F.sum("tokens").alias("total"))
    whole = totals.agg(F.sum("total"), F.max("total")).first()
    all_tokens, largest = whole[0] or 1, (whole[1] or 1) / (whole[0] or 1)
    shares = totals.withColumn("share", F.col("total") / F.lit(all_tokens))
    exponent = exponent_for(shares, max_passes, entropy)
    z = shares.agg(F.sum(F.pow(F.col("share") / F.lit(largest), F.lit(exponent)))).first()[0] or 1.0
    weight = F.pow(F.col("share") / F.lit(largest), F.lit(exponent)) / F.lit(z)
    size = float(budget if budget is not None else all_tokens * largest * z)
    targets = shares.withColumn("weight", weight).withColumn("passes", weight * F.lit(size) / F.col("total"))
    # The largest source's passes are 1 up to rounding: what is within a millionth of a whole number is whole.
    whole_passes = F.floor(F.col("passes") + 1e-6)
    # A pass is the blocks in an order of its own; the last one takes those whose middle lies within what is left of the budget.
    placed = sums.join(targets.withColumn("whole", whole_passes.cast("long")), "source")
    turns = placed.withColumn("pass", F.explode(F.expr("sequence(0L, whole)")))
    ordered = Window.partitionBy("source", "pass").orderBy(F.xxhash64(F.lit(seed + 1), "pass", "source", "block"), "block")
    turns = turns.withColumn("before", F.sum("tokens").over(ordered) - F.col("tokens"))
    left = (F.col("passes") - F.col("whole")) * F.col("total")
    taken = (F.col("pass") < F.col("whole")) | (F.col("before") + F.col("tokens") / 2 <= left)
    start = (F.col("pass") * F.col("total") + F.col("before")) / (F.col("passes") * F.col("total"))
    positions = F.array_sort(F.collect_list(F.when(taken, F.struct(start.alias("start"), (start + F.col("tokens") / (F.col("passes") * F.col("total"))).alias("end")))))
    out = turns.groupBy("source", "block").agg(F.first("share").alias("share"), F.first("weight").alias("weight"), F.first("passes").alias("passes"), positions.alias("turns"))
    return materialize(out.select("source", "block", "share", "weight", "passes", F.size("turns").cast("long").alias("copies"), "turns"), "copies")


def _placed(docs: DataFrame, id_col: str, source_col: str, blocks: int, seed: int) -> DataFrame:
    """``docs`` with its rows' source (null as the empty string) and block, in columns of these names."""
    source = F.coalesce(F.col(source_col).cast("string"), F.lit(""))
    block = F.pmod(F.xxhash64(F.lit(seed), id_col), F.lit(blocks)).cast("int")
    return docs.withColumns({"source": source, "block": block}) if source_col == "source" else docs.drop("source").withColumns({"source": source, "block": block})


def _joined(placed: DataFrame, taken: DataFrame) -> DataFrame:
    taken = taken.select(F.col("source").alias("_s"), F.col("block").alias("_b"), "share", "weight", "passes", "copies", "turns")
    if taken.count() <= BROADCAST_ROWS:
        taken = F.broadcast(taken)
    return placed.join(taken, (F.col("source") == F.col("_s")) & (F.col("block") == F.col("_b"))).drop("_s", "_b")


def plan(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", blocks: int = BLOCKS, seed: int = 17, **limits) -> DataFrame:
    """(``id_col``, source, n_tokens, block, share, weight, passes, copies, positions): how often each row is taken, and where.

    ``weight`` is the source's target share of the mix and ``passes`` the times its tokens fit in its
    budget. ``copies`` is the whole passes, plus one for rows of the blocks that the last, partial pass
    holds, in the order of that pass's block permutation. ``positions`` are the row's places in the mix, from 0 to 1,
    one for each copy: rows of a block lie in its stretches by a hash of their id. Without ``budget`` (tokens of the mix) the
    largest source gets just one pass, so every row is taken at least once. Realised tokens differ from
    a source's budget by at most half a block. Rows with a null source form a source of their own, named by
    the empty string; rows with equal or null ids share a block; null and empty texts count one token.
    Other columns are ignored; an empty table gives no rows.
    """
    taken = block_copies(docs, id_col, source_col, text_col, blocks=blocks, seed=seed, **limits)
    placed = _placed(docs.select(*{id_col: 0, source_col: 0, text_col: 0}), id_col, source_col, blocks, seed)
    placed = placed.select(F.col(id_col), "source", count_tokens(F.col(text_col)).alias("n_tokens"), "block")
    return _joined(placed, taken).select(id_col, "source", "n_tokens", "block", "share", "weight", "passes", "copies", _positions(id_col, seed).alias("positions"))


def _positions(id_col: str, seed: int) -> Column:
    """Of each turn of a row's block, the row's place within: another one each time."""
    part = lambda i: F.pmod(F.xxhash64(F.lit(seed + 2), F.col(id_col), i), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return F.transform("turns", lambda t, i: t["start"] + (t["end"] - t["start"]) * part(i))


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", blocks: int = BLOCKS, seed: int = 17, in_order: bool = False, **limits) -> DataFrame:
    """The rows of ``docs``, each repeated as often as ``plan`` takes it (not at all, if that is zero times).

    With ``in_order`` they are sorted by their positions in the mix, which moves them all once; written as files,
    the mix then reads in the order of the block permutations.
    """
    taken = block_copies(docs, id_col, source_col, text_col, blocks=blocks, seed=seed, **limits)
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(id_col).alias("_id"), F.col(source_col).alias("_source"))
    joined = _joined(_placed(whole, "_id", "_source", blocks, seed), taken)
    repeated = joined.select("_row", F.explode(_positions("_id", seed)).alias("_position"))
    if in_order:
        repeated = repeated.orderBy("_position", F.xxhash64(F.lit(seed + 3), "_row"))
    return repeated.select(*[F.col("_row")[c].alias(c) for c in docs.columns])
