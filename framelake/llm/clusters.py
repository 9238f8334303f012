"""Centroid clustering with heap-ordered bounds, exact in integers.

Vectors lie in blocks, each a row of a table that is dealt by block once; what a block knows about its vectors, its
state, is a second table dealt the same way, so that no round shuffles anything but sums. A vector's gap is the
distance to its second nearest centroid less the distance to its own: while it stays positive the vector keeps its
cluster. When centroids move, a gap of cluster c shrinks by at most what c and the fastest other centroid moved; the
driver adds that up in one number for each cluster, its drift. Each block keeps a heap for each cluster, ordered by
gap plus the drift at the time it was measured, and a round pops those entries that the drift has overtaken: only they
are compared with all centroids, by exact integer distances, and pushed again. Gaps are rounded down and drifts up, so
a tie is always popped and goes to the smaller number.

Means are floors of exact sums: blocks add what joined and take off what left, and hand sums on in limbs of 40 bits,
which Spark adds up. Nothing that grows with the vectors reaches the driver: centroids and drifts have k rows.

Vectors that are null, of another width, or hold null or non-finite components take no part. A null vec_id is a row
like others, after all ids in the choice of first centroids; repeated ids are rows of their own, and equal hashes go by
the vector. Fewer than k vectors give as many centroids; an empty table gives an empty result, and other columns are
ignored. Components of 2**27 and more are handled as Python integers and their vectors compared in every round;
distances and inertias that exceed a long are given as the greatest long.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.session import forget, shared_folder, staged

SCALE = 1024
ROWS = 16_384
SMALL = 1 << 27  # squares of differences of such numbers, 64 of them, fit a long
LIMB, LONG_MAX = 40, (1 << 63) - 1
STATE = "block long, labels binary, sizes array<int>, gaps binary, rows binary, sums array<struct<pos:int,limb:int,value:long>>, scanned long"


def kept(vectors: DataFrame, width: int) -> DataFrame:
    """vec_id, x: the vectors that take part."""
    v = F.col("embedding")
    finite = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf")))
    return vectors.where(v.isNotNull() & (F.size(v) == width) & finite).select(F.col("vec_id").cast("long").alias("vec_id"), v.cast("array<double>").alias("x"))


def quantised(x: np.ndarray) -> np.ndarray:
    """floor(SCALE * x) as longs, or as Python integers where any is large."""
    q = np.abs(x).max(initial=0) * SCALE
    if q < SMALL - 1:
        return np.floor(SCALE * x).astype(np.int64)
    exact = [(n * SCALE) // d for n, d in (float(c).as_integer_ratio() for c in x.ravel())]
    return np.array(exact, object).reshape(x.shape)


def limbs(values: list[int]) -> list[dict]:
    """Integers as sums of value << (LIMB * limb), without zeros."""
    out = []
    for pos, v in enumerate(values):
        limb = 0
        while v:
            low = v if -(1 << LIMB - 1) <= v < 1 << LIMB - 1 else v & ((1 << LIMB) - 1)
            out.append({"pos": pos, "limb": limb, "value": low})
            v, limb = (v - low) >> LIMB, limb + 1
    return out


class Block:
    """The vectors of one block, the cluster of each, and a heap of gaps for each cluster."""

    def __init__(self, x: np.ndarray, centroids: list[list[int]], drift: list[float]):
        self.x, self.k = x, len(centroids)
        small = max((abs(v) for c in centroids for v in c), default=0) < SMALL
        self.centroids = np.array(centroids, np.int64 if small else object)
        self.drift = drift
        self.labels = np.zeros(len(x), np.int32)
        self.heaps: list[list[tuple[float, int]]] = [[] for _ in centroids]
        self.sums = [0] * (self.k * (x.shape[1] + 1))
        self.scanned = 0

    def distances(self, rows: np.ndarray) -> np.ndarray:
        """Squared distances of rows to all centroids, exact."""
        x = self.x[rows]
        if self.centroids.dtype == object:
            x = x.astype(object)
        return np.stack([((x - c) ** 2).sum(axis=1) for c in self.centroids], axis=1)

    def scan(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(nearest, gap): ties to the smaller number; gaps are too small rather than too large."""
        d = self.distances(rows)
        self.scanned += len(rows)
        nearest = d.argmin(axis=1).astype(np.int32)
        if d.dtype == object:
            return nearest, np.full(len(rows), -np.inf)
        if self.k == 1:
            return nearest, np.full(len(rows), np.inf)
        two = np.sqrt(np.partition(d, 1, axis=1)[:, :2].astype(np.float64))
        return nearest, (two[:, 1] - two[:, 0]) - 1e-9 * two.sum(axis=1)

    def _count(self, rows: np.ndarray, labels: np.ndarray, sign: int) -> None:
        width = self.x.shape[1]
        for c in np.unique(labels):
            own = self.x[rows[labels == c]]
            at = int(c) * (width + 1)
            for j, v in enumerate(own.sum(axis=0).tolist()):
                self.sums[at + j] += sign * v
            self.sums[at + width] += sign * len(own)

    def start(self) -> None:
        rows = np.arange(len(self.x))
        self.labels, gaps = self.scan(rows)
        for i, (c, g) in enumerate(zip(self.labels.tolist(), gaps.tolist(), strict=True)):
            self.heaps[c].append((g + self.drift[c], i))
        for h in self.heaps:
            heapq.heapify(h)
        self._count(rows, self.labels, 1)

    def step(self) -> None:
        """Pop what the drift has overtaken, compare it, push it again."""
        popped = []
        for c, h in enumerate(self.heaps):
            while h and not h[0][0] > self.drift[c]:
                popped.append(heapq.heappop(h)[1])
        rows = np.array(popped, np.int64)
        if not len(rows):
            return
        now, gaps = self.scan(rows)
        for i, c, g in zip(popped, now.tolist(), gaps.tolist(), strict=True):
            heapq.heappush(self.heaps[c], (g + self.drift[c], i))
        moved = now != self.labels[rows]
        if moved.any():
            self._count(rows[moved], self.labels[rows[moved]], -1)
            self._count(rows[moved], now[moved], 1)
            self.labels[rows[moved]] = now[moved]

    def state(self, block: int) -> dict:
        entries = [e for h in self.heaps for e in h]
        return {
            "block": block, "labels": self.labels.tobytes(), "sizes": [len(h) for h in self.heaps], "gaps": np.array([g for g, _ in entries], np.float64).tobytes(),
            "rows": np.array([i for _, i in entries], np.int32).tobytes(), "sums": limbs(self.sums), "scanned": self.scanned,
        }

    def resume(self, row: dict) -> None:
        self.labels = np.frombuffer(row["labels"], np.int32).copy()
        entries = list(zip(np.frombuffer(row["gaps"], np.float64).tolist(), np.frombuffer(row["rows"], np.int32).tolist(), strict=True))
        at = 0
        for c, n in enumerate(row["sizes"]):
            self.heaps[c] = entries[at : at + n]
            at += n
        for part in row["sums"]:
            self.sums[part["pos"]] += part["value"] << (LIMB * part["limb"])


def _packed(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Blocks of ROWS vectors of one partition: components in 4 bytes once quantised, in 8 as they are where any is large."""
    from pyspark import TaskContext

    part, n = TaskContext.get().partitionId(), 0
    for batch in batches:
        for lo in range(0, batch.num_rows, ROWS):
            some = batch.slice(lo, ROWS)
            x = np.asarray(some.column("x").flatten()).reshape(-1, width)
            q = quantised(x)
            data = x if q.dtype == object else q.astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array([(part << 32) + n]), pa.array([some.column("vec_id").to_pylist()], pa.list_(pa.int64())), pa.array([data.tobytes()])], ["block", "ids", "x"])
            n += 1


def _read(data: bytes, rows: int, width: int) -> np.ndarray:
    if len(data) == 4 * rows * width:
        return np.frombuffer(data, np.int32).astype(np.int64).reshape(rows, width)
    return quantised(np.frombuffer(data, np.float64).reshape(rows, width))


def _place(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/framelake/{name}"


def _bucketed(df: DataFrame, buckets: int) -> str:
    """Write df in buckets by block, under a name of its own; joins of two such tables need no exchange."""
    name = f"framelake_{uuid.uuid4().hex}"
    df.write.bucketBy(buckets, "block").sortBy("block").option("path", _place(df.sparkSession, name)).format("parquet").saveAsTable(name)
    return name


class Clustering:
    """Rounds of assigning and averaging over a table of vectors."""

    def __init__(self, vectors: DataFrame, k: int = 8, seed: int = 3, width: int = 64):
        self.spark: SparkSession = vectors.sparkSession
        self.width, self.tables, self.scanned = width, [], []
        taking = kept(vectors, width)
        order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
        first = taking.orderBy(order.asc_nulls_last(), "vec_id", "x").limit(k).collect()
        self.centroids = [[int(v) for v in quantised(np.array([r.x]))[0]] for r in first]
        self.drift = [0.0] * len(first)
        if not first:
            return
        blocks = staged(taking.mapInArrow(lambda b: _packed(b, width), "block long, ids array<long>, x binary"), "vector-blocks")
        self.buckets = max(1, min(int(self.spark.conf.get("spark.sql.shuffle.partitions")), blocks.count()))
        self.blocks = self._table(blocks.repartition(self.buckets, "block"))
        self.state = None

    def _table(self, df: DataFrame) -> str:
        self.tables.append(_bucketed(df, self.buckets))
        return self.tables[-1]

    def _joined(self) -> DataFrame:
        blocks = self.spark.table(self.blocks)
        return blocks if self.state is None else blocks.join(self.spark.table(self.state).hint("merge"), "block")

    def assign(self) -> None:
        """Every vector to its nearest centroid."""
        centroids, drift, width, began = self.centroids, self.drift, self.width, self.state is not None

        def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    (row,) = batch.slice(i, 1).to_pylist()
                    b = Block(_read(row["x"], len(row["ids"]), width), centroids, drift)
                    if began:
                        b.resume(row)
                        b.step()
                    else:
                        b.start()
                    yield pa.RecordBatch.from_pylist([b.state(row["block"])], ARROW_STATE)

        before, self.state = self.state, self._table(self._joined().mapInArrow(step, STATE))
        self._drop(before)
        self.scanned.append(self.spark.table(self.state).agg(F.sum("scanned")).first()[0])

    def average(self) -> None:
        """Every centroid that has vectors to the floor of their mean; the drift grows by how far they went."""
        part = F.col("s")
        added = self.spark.table(self.state).select(F.explode("sums").alias("s")).groupBy(part.pos.alias("pos"), part.limb.alias("limb")).agg(F.sum(part.value).alias("value"))
        each, moved = self.width + 1, []
        sums = [0] * (each * len(self.centroids))
        for r in added.collect():  # a few for each component of k centroids
            sums[r.pos] += r.value << (LIMB * r.limb)
        for c, old in enumerate(self.centroids):
            *total, n = sums[c * each : (c + 1) * each]
            new = [t // n for t in total] if n else old
            far = math.isqrt(sum((a - b) ** 2 for a, b in zip(new, old, strict=True)))
            moved.append(0.0 if new == old else (far + 1) * (1 + 1e-9) if far < 1 << 1000 else math.inf)
            self.centroids[c] = new
        for c in range(len(moved)):
            self.drift[c] += (moved[c] + max((m for j, m in enumerate(moved) if j != c), default=0.0)) * (1 + 1e-9)

    def members(self) -> DataFrame:
        """vec_id, cluster, distance (squared) by the state of the last assign()."""
        centroids, width, drift = self.centroids, self.width, self.drift

        def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    (row,) = batch.slice(i, 1).to_pylist()
                    b = Block(_read(row["x"], len(row["ids"]), width), centroids, drift)
                    labels = np.frombuffer(row["labels"], np.int32)
                    own = b.centroids[labels]
                    x = b.x.astype(object) if own.dtype == object else b.x
                    far = [min(int(v), LONG_MAX) for v in ((x - own) ** 2).sum(axis=1)]
                    yield pa.RecordBatch.from_arrays([pa.array(row["ids"], pa.int64()), pa.array(labels), pa.array(far, pa.int64())], ["vec_id", "cluster", "distance"])

        return self._joined().select("block", "ids", "x", "labels").mapInArrow(measured, "vec_id long, cluster int, distance long")

    def _drop(self, name: str | None) -> None:
        if name in self.tables:
            self.tables.remove(name)
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            forget(self.spark, _place(self.spark, name))

    def drop(self) -> None:
        """Forget the tables; what members() gave must be staged by then."""
        for name in list(self.tables):
            self._drop(name)


ARROW_STATE = pa.schema([
    ("block", pa.int64()), ("labels", pa.binary()), ("sizes", pa.list_(pa.int32())), ("gaps", pa.binary()), ("rows", pa.binary()),
    ("sums", pa.list_(pa.struct([("pos", pa.int32()), ("limb", pa.int32()), ("value", pa.int64())]))), ("scanned", pa.int64()),
])


def clustered(vectors: DataFrame, k: int = 8, rounds: int = 10, seed: int = 3, width: int = 64) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 after rounds of assigning and averaging, and a last assigning."""
    run, spark = Clustering(vectors, k, seed, width), vectors.sparkSession
    if not run.centroids:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    for _ in range(rounds):
        run.assign()
        run.average()
    run.assign()
    members = staged(run.members(), "cluster-members")
    run.drop()
    inertia = {r.cluster: int(r.d) for r in members.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}  # k rows
    total = sum(inertia.values())
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in run.centroids]
    each = spark.createDataFrame([(c, min(d, LONG_MAX), min(total, LONG_MAX), digest[c]) for c, d in inertia.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return members.join(F.broadcast(each), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
