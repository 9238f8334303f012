"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

DataFrame functions only. Rows are placed on the ring by a digest of their text, so equal texts meet on one
arc. Every shard accepts the rows of its own arcs up to its capacity; the rest continue clockwise to the next
shard with room. As all rows of an arc see the shards in one order, the walk needs only the number of rows of
each arc: it runs over shards x virtual nodes counts, a bounded table, and each row then finds its place from
its rank on its arc. Ranks come from counts of small cells, so that an arc with a third of all rows is still
dealt over many tasks.

Null texts count as empty, null ids are an id of their own, repeated rows are placed one by one, an empty
table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framelake.llm.rows import joined_back
from framelake.session import staged

SHARDS = 8
VIRTUAL_NODES = 64
#: The ring has 2**48 places, cut into this many equal pieces to look arcs up by equality.
PIECES = 4096
RING_BITS = 48
#: Rows that one cell of an arc should hold at most, and the largest number of cells of an arc.
CELL_ROWS, MAX_CELLS = 2048, 1 << 16


def place(value: Column) -> Column:
    """The 48-bit place of a string on the ring."""
    return F.conv(F.substring(F.md5(value.cast("binary")), 1, RING_BITS // 4), 16, 10).cast("long")


def ring(spark: SparkSession, shards: int, virtual_nodes: int) -> DataFrame:
    """arc, lo, hi (places lo < p <= hi belong to it), prefs: the shards met clockwise from it.

    The arc after the last virtual node wraps round to the first: it appears twice, with one arc number.
    """
    total = shards * virtual_nodes
    name = F.concat_ws(":", (F.col("id") % shards).cast("string"), F.floor(F.col("id") / shards).cast("string"))
    nodes = spark.range(0, total, 1, 1).select((F.col("id") % shards).cast("int").alias("shard"), place(name).alias("at"))
    order = Window.orderBy("at", "shard")
    nodes = nodes.withColumn("i", F.row_number().over(order) - 1)
    twice = nodes.select(F.explode(F.array(F.col("i"), F.col("i") + total)).alias("i"), "shard", "at")
    ahead = Window.orderBy("i").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    steps = [F.struct((F.first(F.when(F.col("shard") == s, F.col("i")), ignorenulls=True).over(ahead) - F.col("i")).alias("d"), F.lit(s).alias("s")) for s in range(shards)]
    arcs = twice.select("i", "at", F.transform(F.array_sort(F.array(*steps)), lambda x: x["s"]).alias("prefs")).where(F.col("i") < total)
    arcs = arcs.select(F.col("i").alias("arc"), F.lag("at", 1, -1).over(Window.orderBy("i")).alias("lo"), F.col("at").alias("hi"), "prefs")
    wrap = arcs.where(F.col("arc") == total - 1).select(F.lit(0).alias("arc"), F.col("hi").alias("lo"), F.lit((1 << RING_BITS) - 1).alias("hi"))
    first = arcs.where(F.col("arc") == 0).select(F.col("arc").alias("arc0"), "prefs")
    wrap = wrap.join(F.broadcast(first), wrap.arc == first.arc0).select("arc", "lo", "hi", "prefs")
    return arcs.unionByName(wrap)


def _pieces(arcs: DataFrame) -> DataFrame:
    """The arcs cut at piece borders, to be joined on the piece: at most PIECES + shards x virtual nodes rows."""
    width = (1 << RING_BITS) // PIECES
    return arcs.where("lo < hi").select(F.explode(F.sequence(F.floor((F.col("lo") + 1) / width).cast("long"), F.floor(F.col("hi") / width).cast("long"))).alias("piece"), "arc", "lo", "hi", "prefs")


def _on_arcs(rows: DataFrame, arcs: DataFrame) -> DataFrame:
    width = (1 << RING_BITS) // PIECES
    rows = rows.withColumn("piece", F.floor(F.col("at") / width).cast("long"))
    found = F.broadcast(_pieces(arcs))
    return rows.join(found, (rows.piece == found.piece) & (rows["at"] > found.lo) & (rows["at"] <= found.hi)).drop("piece", "lo", "hi")


def _walk(counts: DataFrame, shards: int) -> DataFrame:
    """arc, shard, start (rank on the arc), n, base (slot of the first of them) of each run of rows.

    counts: arc, prefs, n - one row per arc. In round r each arc offers what is left to the r-th shard of its
    way; a shard takes offers in ring order until it is full. After as many rounds as shards all is placed.
    """
    one = counts.groupBy().agg(F.array_sort(F.collect_list(F.struct("arc", "prefs", "n"))).alias("arcs"), F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    room = F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: F.floor(F.col("total") / shards) + F.when(s < F.col("total") % shards, 1).otherwise(0))
    offers = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda r: F.transform(F.sequence(F.lit(0), F.size("arcs") - 1), lambda i: F.struct(r.alias("r"), i.alias("i"), F.get(F.get("arcs", i)["prefs"], r).alias("s")))))
    run = "array<struct<r:int,arc:int,shard:int,start:bigint,n:bigint>>"
    empty = F.struct(room.alias("room"), F.transform("arcs", lambda a: a["n"]).alias("left"), F.array().cast(run).alias("runs"))

    def step(state: Column, offer: Column) -> Column:
        left, free = F.get(state["left"], offer["i"]), F.get(state["room"], offer["s"])
        taken = F.least(left, free)
        arc = F.get("arcs", offer["i"])
        new = F.struct(offer["r"].alias("r"), arc["arc"].alias("arc"), offer["s"].alias("shard"), (arc["n"] - left).alias("start"), taken.alias("n"))
        moved = F.struct(
            F.transform(state["room"], lambda x, k: F.when(k == offer["s"], x - taken).otherwise(x)).alias("room"),
            F.transform(state["left"], lambda x, k: F.when(k == offer["i"], x - taken).otherwise(x)).alias("left"),
            F.concat(state["runs"], F.array(new).cast(run)).alias("runs"),
        )
        return F.when(taken > 0, moved).otherwise(state)

    runs = one.where("size(arcs) > 0").select(F.explode(F.aggregate(offers, empty, step)["runs"]).alias("x")).select("x.*")
    base = Window.partitionBy("shard").orderBy("r", "arc").rowsBetween(Window.unboundedPreceding, -1)
    return runs.select("arc", "shard", "start", "n", F.coalesce(F.sum("n").over(base), F.lit(0)).alias("base"))


def sharded(docs: DataFrame, shards: int = SHARDS, virtual_nodes: int = VIRTUAL_NODES, law: str = "rows") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for each row of docs (doc_id, text).

    law "rows": the ring with bounded loads; capacities are the row count over the shards, rounded so that counts
    are at most one apart. law "key": the plain ring over doc_id, without bounds; grown_shard is the shard with
    one shard more, which takes rows only into itself.
    """
    spark = docs.sparkSession
    text, key = F.coalesce(F.col("text").cast("string"), F.lit("")), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    rows = docs.select(
        F.col("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        place(key if law == "key" else text).alias("at"),
        place(F.concat(F.lit("tie:"), key)).alias("tie"),
    )
    owner = F.get("prefs", F.lit(0)).cast("int")
    arcs = staged(ring(spark, shards, virtual_nodes), "ring")
    cells = max(1, min(MAX_CELLS, -(-docs.count() // CELL_ROWS)))
    placed = _on_arcs(rows, arcs)
    if law == "key":
        placed = placed.withColumn("arc", owner).drop("prefs")
        grown = _on_arcs(placed.withColumnRenamed("arc", "shard"), ring(spark, shards + 1, virtual_nodes))
        placed = grown.withColumn("grown_shard", owner).drop("arc").withColumnRenamed("shard", "arc")
    else:
        placed = placed.drop("prefs")
    placed = staged(placed.withColumn("cell", F.pmod(F.col("tie"), F.lit(cells)).cast("int")), "on-ring")
    per_cell = placed.groupBy("arc", "cell").agg(F.count("*").alias("n"))
    before = Window.partitionBy("arc").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_cell.select("arc", "cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    in_cell = Window.partitionBy("arc", "cell").orderBy("tie", "doc_id", "size", "text_crc32")
    ranked = placed.withColumn("rn", F.row_number().over(in_cell) - 1).join(offsets, ["arc", "cell"])
    ranked = ranked.withColumn("rank", F.col("offset") + F.col("rn"))
    if law == "key":
        return ranked.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), F.col("arc").alias("shard"), F.col("rank").alias("slot"), "grown_shard")
    ways = arcs.groupBy("arc").agg(F.first("prefs").alias("prefs"))
    counts = per_cell.groupBy("arc").agg(F.sum("n").alias("n")).join(ways, "arc").select("arc", "prefs", "n")
    runs = F.broadcast(_walk(counts, shards))
    inside = (ranked.arc == runs.arc) & (ranked["rank"] >= runs.start) & (ranked["rank"] < runs.start + runs.n)
    return ranked.join(runs, inside).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), runs.shard.cast("int").alias("shard"), (runs.base + ranked["rank"] - runs.start).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def with_shards(docs: DataFrame, shards: int = SHARDS, virtual_nodes: int = VIRTUAL_NODES) -> DataFrame:
    """docs with columns shard and slot (law "rows"); columns of these names in docs are replaced."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    keys = {"doc_id": F.col("doc_id"), "size": F.octet_length(text).cast("long") + 1, "text_crc32": F.crc32(text.cast("binary"))}
    return joined_back(docs, sharded(docs, shards, virtual_nodes), keys, {"shard": "shard", "slot": "slot"})
