"""Nearest neighbours by cosine with vantage-point trees per shard (operator 9).

Vectors are dealt by hash into shards of about `SHARD`; each task row holds one shard and one block of queries. A shard's tree splits on the median
distance to a vantage point, on the unit sphere, where Euclidean distance orders as cosine does and the triangle inequality holds. A subtree is
skipped when `factor` times its least possible distance exceeds the k-th best so far: a factor above one skips more and may miss some, factor one is
exact. Scores are computed again from the original vectors in double precision, and the k best of all shards win.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wiresift.llm.common import stored

SHARD, BLOCK, LEAF, FACTOR = 4096, 256, 128, 1.0
#: Slack for rounding when distances are compared.
EPS = 1e-7


class Tree:
    """Nodes in preorder; a leaf is a range of `order`. Inner nodes have a vantage point and the median distance to it."""

    def __init__(self, unit: np.ndarray, leaf: int = LEAF):
        self.unit, self.order, self.nodes = unit, np.arange(len(unit)), []
        self._grow(0, len(unit), leaf)

    def _grow(self, lo: int, hi: int, leaf: int) -> int:
        at = len(self.nodes)
        self.nodes.append(None)
        if hi - lo <= leaf:
            self.nodes[at] = (lo, hi, -1, 0.0, 0.0, 0.0, -1, -1)
            return at
        own = self.order[lo:hi]
        # the vantage point: of a few, the one farthest from the middle
        some = self.unit[own[:: max(1, len(own) // 32)]]
        point = int(own[:: max(1, len(own) // 32)][np.linalg.norm(some - self.unit[own].mean(0), axis=1).argmax()])
        distance = np.linalg.norm(self.unit[own] - self.unit[point], axis=1)
        half = len(own) // 2
        by = np.argpartition(distance, half)
        self.order[lo:hi], distance = own[by], distance[by]
        inner, outer, far = float(distance[:half].max()), float(distance[half:].min()), float(distance[half:].max())
        left = self._grow(lo, lo + half, leaf)
        right = self._grow(lo + half, hi, leaf)
        self.nodes[at] = (lo, hi, point, inner, outer, far, left, right)
        return at

    def search(self, queries: np.ndarray, k: int, factor: float, same: np.ndarray) -> list[np.ndarray]:
        """For each query the rows that may be among its k nearest; same: its own row here, or -1."""
        best = np.full((len(queries), k), np.inf)
        found = [[] for _ in queries]

        def visit(at: int, who: np.ndarray):
            lo, hi, point, inner, outer, far, left, right = self.nodes[at]
            if point < 0:
                rows = self.order[lo:hi]
                d = np.sqrt(np.maximum(2 - 2 * queries[who] @ self.unit[rows].T, 0))
                d[same[who][:, None] == rows[None, :]] = np.inf
                near = np.concatenate([best[who], d], 1)
                best[who] = np.partition(near, k - 1, axis=1)[:, :k]
                limit = best[who].max(1) + EPS
                for i, q in enumerate(who):
                    close = (d[i] <= limit[i]) & (d[i] < np.inf)
                    if close.any():
                        found[q].append((rows[close], d[i][close]))
                return
            d = np.linalg.norm(queries[who] - self.unit[point], axis=1)
            least = np.maximum(d - inner, 0), np.maximum(np.maximum(outer - d, d - far), 0)
            first = least[0] <= least[1]
            for near in (True, False):  # the nearer side first, for each query
                for side, child in ((0, left), (1, right)):
                    mine = first == (near == (side == 0))
                    go = mine & (factor * least[side] <= best[who].max(1) + EPS)
                    if go.any():
                        visit(child, who[go])
        visit(0, np.arange(len(queries)))
        out = []
        for q, parts in enumerate(found):
            limit = best[q].max() + EPS
            out.append(np.concatenate([r[d <= limit] for r, d in parts]) if parts else np.zeros(0, np.int64))
        return out


def _matrix(blob: bytes, n: int) -> np.ndarray:
    return np.frombuffer(blob, np.float64).reshape(n, -1)


def _near_one(x: np.ndarray) -> np.ndarray:
    """Rows times a power of two each, so that their largest component is near 1: squares neither overflow nor vanish, and cosines stay what they are to the last bit."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None])


def _packs(batches):
    """Vectors of one (dim, part) in one row: ids and the float64 matrix. Rows of a part stand together and in order."""
    key, ids, rows, size = None, [], [], 0
    def emit():
        return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([np.stack(rows).tobytes()], pa.binary())], names=["dim", "part", "ids", "matrix"])
    for batch in batches:
        for dim, part, vec_id, vector in zip(*(batch.column(i) for i in range(4))):
            now = (dim.as_py(), part.as_py())
            if key is not None and now != key:
                yield emit()
                ids, rows = [], []
            key = now
            ids.append(vec_id.as_py())
            rows.append(vector.values.to_numpy(zero_copy_only=False).astype(np.float64))
    if key is not None:
        yield emit()


def _search(k: int, factor: float):
    def run(batches):
        tree, known = None, None
        for batch in batches:
            out = {"query_id": [], "vec_id": [], "score": []}
            for part, ids, blob, query_ids, query_blob in zip(*(batch.column(i) for i in range(5))):
                ids, query_ids = ids.values.to_numpy(), query_ids.values.to_numpy()
                vectors, queries = _near_one(_matrix(blob.as_py(), len(ids))), _near_one(_matrix(query_blob.as_py(), len(query_ids)))
                norms, query_norms = np.sqrt((vectors * vectors).sum(1)), np.sqrt((queries * queries).sum(1))
                if known != part.as_py():
                    tree, known = Tree(vectors / norms[:, None]), part.as_py()
                place = {int(x): i for i, x in enumerate(ids)}
                same = np.array([place.get(int(x), -1) for x in query_ids])
                for q, rows in enumerate(tree.search(queries / query_norms[:, None], k, factor, same)):
                    score = (vectors[rows] * queries[q]).sum(1) / (norms[rows] * query_norms[q])
                    order = np.lexsort((ids[rows], -score))[:k]
                    out["query_id"] += [int(query_ids[q])] * len(order)
                    out["vec_id"] += ids[rows][order].tolist()
                    out["score"] += score[order].tolist()
            yield pa.RecordBatch.from_arrays([pa.array(out["query_id"], pa.int64()), pa.array(out["vec_id"], pa.int64()), pa.array(out["score"], pa.float64())], names=list(out))
    return run


def usable(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """Rows whose id and vector are not null, with no null or non-finite component and some component that is not zero; `vector` as doubles."""
    v = F.col(vector).cast("array<double>")
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    ok = F.col("vec_id").isNotNull() & v.isNotNull() & ~F.exists(v, odd) & F.exists(v, lambda x: x != 0)
    return vectors.where(ok).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("vector"), F.size(v).alias("dim"))


def nearest(vectors: DataFrame, queries, k: int = 5, factor: float = FACTOR, vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows of each row for which the condition `queries` (on vec_id) holds, itself left out.

    Ties go to the smaller vec_id. Rows that `usable` drops take no part; only vectors of equal length are compared. Rows that share a vec_id count
    as one vector if equal (one copy stays) and as several candidates otherwise. Fewer candidates than k are all returned; none, no row.
    """
    clean = usable(vectors, vector).dropDuplicates(["vec_id", "vector"])
    clean = stored(clean, "vectors")
    rows = {r.dim: r["count"] for r in clean.groupBy("dim").count().collect()}  # one row for each vector length
    if not rows:
        return clean.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    parts = F.greatest(F.lit(1), F.ceil(F.element_at(F.create_map(*[F.lit(x) for d, n in rows.items() for x in (d, n)]), F.col("dim")) / SHARD))
    packed = "dim int, part long, ids array<long>, matrix binary"

    def packs(df, parts):
        dealt = df.withColumn("part", F.pmod(F.xxhash64("vec_id"), parts).cast("long"))
        return dealt.repartition("dim", "part").sortWithinPartitions("dim", "part", "vec_id").select("dim", "part", "vec_id", "vector").mapInArrow(_packs, packed)
    asked = clean.where(queries)
    shards = stored(packs(clean, parts), "shards")
    blocks = stored(packs(asked, F.greatest(F.lit(1), F.ceil(parts * SHARD / (50 * BLOCK)))), "queries")
    # every block of queries visits every shard: the search's own work, in blocks of rows
    met = shards.join(blocks.select("dim", F.col("ids").alias("query_ids"), F.col("matrix").alias("query_matrix")), "dim")
    spread = met.repartition("dim", "part").sortWithinPartitions("dim", "part").select(F.concat_ws("/", "dim", "part").alias("shard"), "ids", "matrix", "query_ids", "query_matrix")
    found = spread.mapInArrow(_search(k, factor), "query_id long, vec_id long, score double")
    by = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
