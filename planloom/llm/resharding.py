"""Resharding by minimum-cost flow.

Rows lie in old shards; new shards get equal capacities in bytes. A flow from old shards to new ones, in
which staying costs nothing and a moved byte costs one, gives the block transfers that move the fewest
bytes. The flow runs over shards, so it is a small problem on the driver whatever the number of rows.
It is realised by running sums over hashed blocks: a block goes whole to the shard whose stretch of its
old shard's bytes it falls in, and only blocks that a boundary cuts are ordered row by row. A shard with
too much gives its small rows first, and the smallest ones make good what the others miss: no shard both
gives and takes, so the bytes moved are the flow's, up to a few small rows.
"""

from __future__ import annotations

import heapq
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType
from pyspark.sql.window import Window

from planloom.llm.common import materialize, with_places, work_path

SHARDS, OLD_SHARDS, BLOCK_ROWS = 16, 12, 50_000
#: Rows are placed in tiers by size: from the first number up, then from the next, and so on.
TIERS = (32_768, 8_192, 4_096, 2_048, 1_024, 512, 256)
#: Of what smaller rows could move, the share that larger rows count on; the rest is there to correct.
SLACK = 0.9
CHOICE = 64


def equal_capacities(total: int, shards: int, giants: dict[int, int] | None = None) -> list[int]:
    """Capacities that differ by at most one byte and sum up to ``total``; shards with a row over that get its size."""
    giants = {k: x for k, x in sorted((giants or {}).items(), key=lambda g: -g[1])[: shards - 1]}
    rest = iter([(total - sum(giants.values())) // (shards - len(giants)) + (k < (total - sum(giants.values())) % (shards - len(giants))) for k in range(shards - len(giants))])
    return [giants[k] if k in giants else next(rest) for k in range(shards)]


def min_cost_flow(supply: list[int], demand: list[int], cost=lambda i, j: int(i != j)) -> dict[tuple[int, int], int]:
    """Amounts (i, j) -> x with all of ``supply`` sent within ``demand``, at the least sum of cost * x.

    Successive shortest paths with potentials on the bipartite network; costs must not be negative.
    """
    if sum(demand) < sum(supply):
        raise ValueError("the capacities are too small")
    m, n = len(supply), len(demand)
    source, sink = m + n, m + n + 1
    graph: list[list[list[int]]] = [[] for _ in range(m + n + 2)]  # edges: to, capacity, cost, index of the reverse

    def add(a: int, b: int, capacity: int, price: int) -> None:
        graph[a].append([b, capacity, price, len(graph[b])])
        graph[b].append([a, 0, -price, len(graph[a]) - 1])

    for i, x in enumerate(supply):
        add(source, i, x, 0)
        for j in range(n):
            add(i, m + j, x, cost(i, j))
    for j, x in enumerate(demand):
        add(m + j, sink, x, 0)
    potential, left = [0] * len(graph), sum(supply)
    while left > 0:
        distance: list[float] = [float("inf")] * len(graph)
        distance[source], back, heap = 0, {}, [(0, source)]
        while heap:
            d, a = heapq.heappop(heap)
            if d > distance[a]:
                continue
            for k, (b, capacity, price, _) in enumerate(graph[a]):
                e = d + price + potential[a] - potential[b]
                if capacity > 0 and e < distance[b]:
                    distance[b], back[b] = e, (a, k)
                    heapq.heappush(heap, (e, b))
        potential = [p + (d if d < float("inf") else 0) for p, d in zip(potential, distance)]
        path, at = [], sink
        while at != source:
            a, k = back[at]
            path.append((a, k))
            at = a
        amount = min(left, *(graph[a][k][1] for a, k in path))
        for a, k in path:
            graph[a][k][1] -= amount
            graph[graph[a][k][0]][graph[a][k][3]][1] += amount
        left -= amount
    return {(i, e[0] - m): supply[i] - e[1] for i in range(m) for e in graph[i] if e[0] != source and supply[i] > e[1]}


def _stretches(need: dict[tuple[int, int], int], supply: dict[int, int]) -> list[tuple[int, int, int, int]]:
    """(old, new, from, to): each old shard's bytes of a tier in turn, what stays first, as the flow ``need`` parts them."""
    out = []
    for i, size in supply.items():
        parts = sorted(((j, x) for (a, j), x in need.items() if a == i), key=lambda p: (p[0] != i, p[0]))
        whole, at, done = sum(x for _, x in parts), 0, 0.0
        for j, x in parts:
            done += x
            to = round(size * done / whole) if j != parts[-1][0] else 1 << 62
            if to > at:
                out.append((i, j, at, to))
            at = to
    return out


def _place(rows: DataFrame, blocks: DataFrame, stretches: list[tuple[int, int, int, int]]) -> DataFrame:
    """``rows`` of one tier with their new shard: blocks within a stretch whole, the others row by row."""
    table = F.broadcast(rows.sparkSession.createDataFrame(stretches, "s_old int, shard int, s_from long, s_to long"))  # at most old shards times new shards rows
    running = Window.partitionBy("old_shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    placed = blocks.withColumn("before", F.coalesce(F.sum("bytes").over(running), F.lit(0)))
    inside = (F.col("old_shard") == F.col("s_old")) & (F.col("before") < F.col("s_to")) & (F.col("before") + F.col("bytes") > F.col("s_from"))
    touched = placed.join(table, inside).groupBy("old_shard", "block", "before").agg(F.min("shard").alias("one"), F.count("*").alias("parts"))
    touched = touched.select(F.col("old_shard").alias("t_old"), F.col("block").alias("t_block"), "before", F.when(F.col("parts") == 1, F.col("one")).alias("one"))
    joined = rows.join(touched, (F.col("old_shard") == F.col("t_old")) & (F.col("block") == F.col("t_block"))).drop("t_old", "t_block")
    whole = joined.where("one IS NOT NULL").select(*rows.columns, F.col("one").alias("shard"))
    in_block = Window.partitionBy("old_shard", "block").orderBy(F.desc("size"), "key").rowsBetween(Window.unboundedPreceding, -1)
    cut = joined.where("one IS NULL").withColumn("middle", F.col("before") + F.coalesce(F.sum("size").over(in_block), F.lit(0)) + F.col("size") / 2)
    cut = cut.join(table, (F.col("old_shard") == F.col("s_old")) & (F.col("middle") >= F.col("s_from")) & (F.col("middle") < F.col("s_to"))).select(*rows.columns, "shard")
    return whole.unionByName(cut)


def _evened(placed: DataFrame, capacities: list[int]) -> DataFrame:
    """``placed`` with a few rows of shards over their capacity moved to those below it, where small rows were too few.

    Of each shard that is over, one row for each ``CHOICE``-th of the excess is looked at: shards times CHOICE in all.
    """
    load = dict.fromkeys(range(len(capacities)), 0) | {j: x for j, x in placed.groupBy("shard").agg(F.sum("size")).collect()}
    over = {j: x - capacities[j] for j, x in load.items() if x > capacities[j]}
    room = {j: capacities[j] - x for j, x in load.items() if x < capacities[j]}
    if not over or not room:
        return placed
    table = F.broadcast(placed.sparkSession.createDataFrame(list(over.items()), "shard int, over long"))
    near = placed.join(table, "shard").where("size <= over").groupBy("shard", F.floor(F.col("size") * CHOICE / F.col("over")).alias("part")).agg(F.max(F.struct("size", "key")).alias("r"))
    moves = []
    for j, (x, key) in sorted(((r[0], r[1]) for r in near.select("shard", "r").collect()), key=lambda c: -c[1][0]):
        k = max(room, key=room.get)
        if x <= over[j] and x <= room[k]:
            moves.append((key, k))
            over[j] -= x
            room[k] -= x
    if not moves:
        return placed
    other = F.broadcast(placed.sparkSession.createDataFrame(moves, "key struct<f: long, i: long>, other int"))
    return placed.join(other, "key", "left").withColumn("shard", F.coalesce("other", "shard")).drop("other")


def reshard(docs: DataFrame, shards: int = SHARDS, old_shard: str | None = None, id_col: str = "doc_id", text_col: str = "text", capacities: list[int] | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(``id_col``, size, text_crc32, old_shard, shard, slot) for every row of ``docs``.

    ``size`` is the UTF-8 bytes of the text (null: none) plus 1; old shard k and new shard k are the same
    place. ``old_shard`` names the column with the old shard numbers (0 up); without it rows lie in
    OLD_SHARDS shards by a hash of their id. New shards get equal bytes, or ``capacities``. The flow is
    realised from the tier of the largest rows down, each tier making good what the ones before missed, so a
    shard misses its size by a few of the smallest rows. Slots number each shard's
    rows gaplessly from 0. Rows with equal ids may part; null ids are one more value to hash. Other columns
    are ignored; an empty table gives no rows.
    """
    rows = _rows(with_places(docs), old_shard, id_col, text_col)
    return _layout(rows, shards, capacities, block_rows).select(F.col("id").alias(id_col), "size", "text_crc32", "old_shard", "shard", "slot")


def _rows(places: DataFrame, old_shard: str | None, id_col: str, text_col: str) -> DataFrame:
    """(id, size, text_crc32, old_shard, key) of each row, written: ``key`` is its place."""
    row_id, data = F.col("row")[id_col], F.coalesce(F.col("row")[text_col], F.lit("")).cast("binary")
    old = F.col("row")[old_shard].cast("int") if old_shard else F.pmod(F.xxhash64(F.lit(3), row_id), F.lit(OLD_SHARDS)).cast("int")
    return materialize(places.select(row_id.alias("id"), (F.octet_length(data) + 1).cast("long").alias("size"), F.crc32(data).alias("text_crc32"), old.alias("old_shard"), "key"), "rows")


def _layout(rows: DataFrame, shards: int, capacities: list[int] | None, block_rows: int) -> DataFrame:
    """The columns of ``_rows`` with shard and slot."""
    count = rows.count()
    per_shard = max(64, -(-count // (block_rows * OLD_SHARDS)))
    tier = sum((F.col("size") < least).cast("int") for least in TIERS)
    rows = rows.withColumn("tier", tier).withColumn("block", F.pmod(F.xxhash64(F.lit(5), "key"), F.lit(per_shard)).cast("int"))
    blocks = materialize(rows.groupBy("tier", "old_shard", "block").agg(F.sum("size").alias("bytes")), "blocks")
    sizes = {(r[0], r[1]): r[2] for r in blocks.groupBy("tier", "old_shard").agg(F.sum("bytes")).collect()}  # a row for each tier and old shard
    names = range(max((i for _, i in sizes), default=-1) + 1)
    supply = [sum(x for (_, a), x in sizes.items() if a == i) for i in names]
    if capacities is None:
        giants = rows.where(F.col("size") > sum(supply) // shards).groupBy("old_shard").agg(F.max("size")).collect()  # fewer than ``shards`` rows are so large
        capacities = equal_capacities(sum(supply), shards, {i: x for i, x in giants if i < shards})
    flow = min_cost_flow(supply, capacities)
    room = len(capacities)
    # What each old shard has to give away, and what each new one may still take. Shards past the new ones give all.
    out_ = {i: sum(x for (a, j), x in flow.items() if a == i and j != i) for i in names}
    want = [sum(x for (a, b), x in flow.items() if b == j and a != j) for j in range(room)]
    moved = []
    for t in sorted({t for t, _ in sizes}):
        here = {i: x for (k, i), x in sizes.items() if k == t}
        below = {i: sum(x for (k, a), x in sizes.items() if k > t and a == i) for i in here}
        give = {i: x if i >= room else int(min(x, max(0, out_[i] - SLACK * below[i]))) for i, x in here.items()}
        short = sum(give.values()) - sum(want)
        takers = [j for j in range(room) if want[j]] or [max(range(room), key=lambda j: capacities[j])]
        demand = [max(0, w) + (-(-short // len(takers)) if short > 0 and j in takers else 0) for j, w in enumerate(want)]
        need = min_cost_flow([give.get(i, 0) for i in names], demand, lambda i, j: int(i != j))
        for i, x in here.items():
            if x > give[i]:
                need[i, i] = need.get((i, i), 0) + x - give[i]
        done = materialize(_place(rows.where(F.col("tier") == t), blocks.where(F.col("tier") == t), _stretches(need, here)), "moved")
        for i, j, x in done.where("shard != old_shard").groupBy("old_shard", "shard").agg(F.sum("size")).collect():  # at most old shards times new shards rows
            out_[i] = max(0, out_[i] - x)
            want[j] = max(0, want[j] - x)
        moved.append(done)
    if not moved:
        return rows.select("id", "size", "text_crc32", "old_shard", "key", F.lit(None).cast("int").alias("shard"), F.lit(None).cast("long").alias("slot"))
    placed = _evened(reduce(DataFrame.unionByName, moved), capacities)
    # Slots: a running count over (shard, old shard, tier, block), then the row's number within.
    parts = ["shard", "old_shard", "tier", "block"]
    groups = placed.groupBy(*parts).agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("shard").orderBy(*parts[1:]).rowsBetween(Window.unboundedPreceding, -1)
    bases = groups.select(*[F.col(c).alias(f"g_{c}") for c in parts], F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    number = F.row_number().over(Window.partitionBy(*parts).orderBy("key")) - 1
    numbered = placed.withColumn("number", number).join(bases, reduce(lambda a, b: a & b, [F.col(c) == F.col(f"g_{c}") for c in parts]))
    return numbered.select("id", "size", "text_crc32", "old_shard", "key", "shard", (F.col("base") + F.col("number")).cast("long").alias("slot"))


def rewrite(docs: DataFrame, new_path: str, shards: int = SHARDS, old_shard: str | None = None, id_col: str = "doc_id", text_col: str = "text", capacities: list[int] | None = None, block_rows: int = BLOCK_ROWS, all_shards: bool = False) -> list[int]:
    """``reshard`` and write the shards that it changes to ``new_path``/shard=k; their numbers are returned.

    A shard that keeps just the rows it had stays where it is and is not written, unless ``all_shards``. Files hold
    the rows of ``docs`` in whole, as the struct ``row``, each file in the order of ``slot``; a shard is written by
    many tasks, so none holds it whole. Ids may be null or repeated. Of an empty table nothing is written.
    """
    places = with_places(docs)
    layout = materialize(_layout(_rows(places, old_shard, id_col, text_col), shards, capacities, block_rows).select("key", "old_shard", "shard", "slot"), "layout")
    ends = layout.select(F.explode(F.array("old_shard", "shard")).alias("k")) if all_shards else layout.where("shard != old_shard").select(F.explode(F.array("old_shard", "shard")).alias("k"))
    numbers = sorted(r[0] for r in ends.distinct().collect() if r[0] < (len(capacities) if capacities else shards))  # shard numbers
    if numbers:
        # The layout has a row for each row of the table: it is never small enough to be sent to every task.
        out = places.join(layout.where(F.col("shard").isin(numbers)).select("key", "shard", "slot").hint("merge"), "key").drop("key")
        out.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(new_path)
    return numbers


def rewritten(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """(``id_col``, size, text_crc32, shard, slot) of every row, taken from the files of all new shards, written and read back."""
    path = work_path(docs.sparkSession, "shards")
    data = F.coalesce(F.col("row")[text_col], F.lit("")).cast("binary")
    kind = docs.schema
    if not rewrite(docs, path, shards, id_col=id_col, text_col=text_col, all_shards=True, **how):
        return docs.limit(0).select(F.col(id_col), F.lit(0).cast("long").alias("size"), F.lit(0).cast("long").alias("text_crc32"), F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    back = docs.sparkSession.read.schema(StructType([StructField("row", kind), StructField("slot", LongType()), StructField("shard", IntegerType())])).parquet(path)
    return back.select(F.col("row")[id_col].alias(id_col), (F.octet_length(data) + 1).cast("long").alias("size"), F.crc32(data).alias("text_crc32"), "shard", "slot")
