"""Lloyd's clustering of integer vectors, sharded by dimension.

Vectors are laid out once, in the shared folder, as blocks: up to 4,096 vectors by 16 components. A round has three steps. Every block measures its vectors against its
slice of the centroids (exact integers); reduceByKey adds the blocks of a chunk of vectors and takes the nearest centroid; the labels go back to the chunk's blocks, which stay where they are, and each column
shard sums its components and moves its own slice. Only centroids and their sums, clusters x components numbers, reach the driver.

Blocks are dealt to partitions once: later rounds read the same shuffle files, and a lost executor's part is made again from the written blocks.

Rows: only vectors of exactly `dims` components, none of them null or not finite, take part; a null id counts as an empty one in the choice of the first centroids, where ties go to the smaller
vector; rows that repeat an id or a vector are vectors of their own; with fewer vectors than clusters there are as many clusters as vectors; an empty table gives an empty result. Numbers of any size are exact (Python integers
where 64 bits are not enough); a distance or sum beyond 64 bits is null in the result. Other columns are not read, whatever their names.
"""
from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wiresift.llm.common import small_batches, stored

CHUNK, SLICE = 4096, 16
LIMIT = 1 << 63


def whole(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) of doubles, as 64-bit integers or, where one does not fit, as Python integers. `scale` is a power of two, so that the product is exact."""
    if not x.size or np.abs(x).max() * scale < LIMIT / 2:
        return np.floor(x * scale).astype(np.int64)
    exact = [math.floor(v * scale) if abs(v) < 2.0**53 else int(v) * scale for v in x.ravel().tolist()]
    return np.array(exact, object).reshape(x.shape)


def pack(x: np.ndarray) -> bytes:
    """A byte with the width of a number, then little-endian numbers: 8 bytes each, or more for Python integers."""
    if x.dtype != object:
        return b"\x08" + x.astype("<i8").tobytes()
    width = max(9, max(v.bit_length() for v in x.flat) // 8 + 1)
    return bytes([width]) + b"".join(v.to_bytes(width, "little", signed=True) for v in x.flat)


def unpack(raw: bytes, n: int) -> np.ndarray:
    """The numbers of `pack`, as n rows."""
    width = raw[0]
    if width == 8:
        return np.frombuffer(raw, "<i8", offset=1).reshape(n, -1)
    return np.array([int.from_bytes(raw[i:i + width], "little", signed=True) for i in range(1, len(raw), width)], object).reshape(n, -1)


def partial(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances of rows to centroids over the columns at hand."""
    if x.dtype == object or centroids.dtype == object or (int(np.abs(x).max()) + int(np.abs(centroids).max())) ** 2 * x.shape[1] >= LIMIT:
        x, centroids = x.astype(object), centroids.astype(object)
    out = np.empty((len(x), len(centroids)), x.dtype)
    for k, c in enumerate(centroids):
        gap = x - c
        out[:, k] = (gap * gap).sum(axis=1)
    return out


def added(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    if a.dtype == object or b.dtype == object or int(a.max()) + int(b.max()) >= LIMIT:
        return a.astype(object) + b.astype(object)
    return a + b


def sums(x: np.ndarray, labels: np.ndarray, k: int) -> np.ndarray:
    """Sum of the rows of each label, and how many there are, as Python integers."""
    if x.dtype != object and int(np.abs(x).max()) * len(x) >= LIMIT:
        x = x.astype(object)
    out = np.zeros((k, x.shape[1] + 1), object)
    for c in np.unique(labels):
        own = x[labels == c]
        out[c, :-1] = [int(v) for v in own.sum(axis=0)]
        out[c, -1] = len(own)
    return out


def moved(total: np.ndarray, was: np.ndarray) -> np.ndarray:
    """Centroids after a round: floor of the mean, or the old place of one without vectors."""
    return np.array([[int(v) // int(row[-1]) for v in row[:-1]] if row[-1] else [int(v) for v in old] for row, old in zip(total, was, strict=True)], object)


def _blocks(dims: int, scale: int):
    def run(batches):
        chunk = TaskContext.get().partitionId() << 32
        for batch in batches:
            for s in range(0, batch.num_rows, CHUNK):
                part = batch.slice(s, CHUNK)
                x = whole(part.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(-1, dims), scale)
                chunk += 1
                for shard, d in enumerate(range(0, dims, SLICE)):
                    ids = pa.array([part.column("id").to_pylist()] if d == 0 else [None], pa.list_(part.column("id").type))
                    cells = x[:, d:d + SLICE]
                    yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.array([shard], pa.int32()), pa.array([part.num_rows], pa.int32()), pa.array([pack(cells)], pa.binary()), ids], ["chunk", "shard", "n", "cells", "ids"])
    return run


def _nearest(distances: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    labels = np.argmin(distances, axis=1).astype(np.int32)
    return labels, distances[np.arange(len(labels)), labels]


def cluster(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", dims: int = 64, k: int = 8, rounds: int = 10, scale: int = 1024, salt: str = "3") -> DataFrame:
    """(id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every vector that takes part, after `rounds` rounds from the `k` vectors of least SHA-256 of `<salt>:<id>`."""
    spark = df.sparkSession
    sc = spark.sparkContext
    small_batches(spark)
    x = F.col("vector")
    sound = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    rows = df.select(df[f"`{id_col}`"].alias("id"), df[f"`{vector_col}`"].cast("array<double>").alias("vector")).where(x.isNotNull() & (F.size(x) == dims) & sound)
    mark = F.sha2(F.concat(F.lit(f"{salt}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    first = rows.select(mark.alias("mark"), "vector").orderBy("mark", "vector").limit(k).collect()
    kind = T.StructType([T.StructField(id_col, rows.schema["id"].dataType), T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType()),
                         T.StructField("cluster_inertia", T.LongType()), T.StructField("inertia", T.LongType()), T.StructField("centroid_sha256", T.StringType())])
    if not first:
        return spark.createDataFrame([], kind)
    centroids, k = whole(np.array([r.vector for r in first]), scale), len(first)

    schema = T.StructType([T.StructField("chunk", T.LongType()), T.StructField("shard", T.IntegerType()), T.StructField("n", T.IntegerType()), T.StructField("cells", T.BinaryType()), T.StructField("ids", T.ArrayType(rows.schema["id"].dataType))])
    blocks = stored(rows.mapInArrow(_blocks(dims, scale), schema), "blocks")
    shards = range(-(-dims // SLICE))
    count = blocks.count()
    parts = max(min(count, 2 * sc.defaultParallelism), count // 32)
    dealt = blocks.select("chunk", "shard", "n", "cells").rdd.map(lambda r: ((r.chunk, r.shard), (r.n, bytes(r.cells)))).partitionBy(parts)

    def measured(now):
        slices = [now[:, s * SLICE:(s + 1) * SLICE] for s in shards]
        return dealt.map(lambda b: (b[0][0], partial(unpack(b[1][1], b[1][0]), slices[b[0][1]]))).reduceByKey(added, parts).mapValues(_nearest)

    for _ in range(rounds):
        back = measured(centroids).flatMap(lambda c: [((c[0], s), c[1][0]) for s in shards]).partitionBy(parts)
        total = dealt.join(back, parts).map(lambda b: (b[0][1], sums(unpack(b[1][0][1], b[1][0][0]), b[1][1], k))).reduceByKey(lambda a, b: a + b, len(shards))
        was = {s: centroids[:, s * SLICE:(s + 1) * SLICE] for s in shards}
        new = dict(total.map(lambda t: (t[0], moved(t[1], was[t[0]]))).collect())
        centroids = np.concatenate([new[s] for s in shards], axis=1)
        if max(abs(v) for v in centroids.flat) < LIMIT // 2:
            centroids = centroids.astype(np.int64)

    long = lambda v: int(v) if v < LIMIT else None
    last = measured(centroids).map(lambda c: (c[0], c[1][0].tolist(), [long(v) for v in c[1][1].tolist()], {int(j): sum(int(v) for v in c[1][1][c[1][0] == j]) for j in np.unique(c[1][0])}))
    found = stored(last.map(lambda c: (c[0], c[1], c[2], {j: str(v) for j, v in c[3].items()})).toDF("chunk long, cluster array<int>, distance array<long>, inertia map<int, string>"), "labels")
    inertia = dict(found.select(F.explode("inertia")).rdd.map(lambda r: (r[0], int(r[1]))).reduceByKey(lambda a, b: a + b, 1).collect())
    whole_sum = sum(inertia.values())
    stats = spark.createDataFrame([(j, long(inertia.get(j, 0)), long(whole_sum), hashlib.sha256(",".join(str(int(v)) for v in centroids[j]).encode()).hexdigest()) for j in range(k)], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    each = blocks.where("shard = 0").join(found, "chunk").select(F.explode(F.arrays_zip("ids", "cluster", "distance")).alias("v"))
    return each.select(F.col("v.ids").alias(id_col), F.col("v.cluster").alias("cluster"), F.col("v.distance").alias("distance")).join(F.broadcast(stats), "cluster").select(*kind.names)
