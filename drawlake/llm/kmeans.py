"""K-means on integer vectors with Drake's adaptive bounds.

Every vector keeps an upper bound of the distance to its centroid, lower bounds of the distances
to the few centroids that were next, and one lower bound for all that remain. When centroids
move, bounds are widened by how far. A vector whose upper bound stays under all lower bounds
keeps its centroid unseen; else its own distance is taken anew, then those of as many next
centroids as it takes until the remaining bounds certify the order; where none does, all
centroids are scanned. Distances are exact integers, so the clusters are those of plain
k-means. Each round is written, as bounds must live on; nothing but the sums of the clusters
reaches the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from drawlake.llm.common import frugal, small_batches, table, written
from drawlake.llm.vectors import lists, products, scaled
from drawlake.storage import drop_written


@dataclass(frozen=True)
class KMeansOptions:
    clusters: int = 16
    rounds: int = 3
    dimensions: int = 64
    scale: int = 64
    bounds: int = 4  # next centroids whose lower bounds a vector keeps
    seed: str = "1"


@dataclass
class State:
    """Cluster, bounds and next centroids of some vectors."""

    cluster: np.ndarray
    upper: np.ndarray
    near: np.ndarray  # vectors x bounds
    low: np.ndarray
    rest: np.ndarray


def squared(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows to centroids."""
    return (x * x).sum(axis=1)[:, None] - 2 * products(x, centroids) + (centroids * centroids).sum(axis=1)


def scan(x: np.ndarray, centroids: np.ndarray, bounds: int) -> State:
    """Clusters and bounds from all centroids; of equally near ones the smaller number."""
    d = squared(x, centroids)
    order = np.argsort(d, axis=1, kind="stable")
    far = np.sqrt(np.take_along_axis(d, order, axis=1).astype(float))
    rest = far[:, bounds + 1] if far.shape[1] > bounds + 1 else np.full(len(x), np.inf)
    return State(order[:, 0].copy(), far[:, 0].copy(), order[:, 1 : bounds + 1].copy(), far[:, 1 : bounds + 1].copy(), rest.copy())


def moved(before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """At least how far each centroid has moved, with room for rounding."""
    d = ((before - after) ** 2).sum(axis=1)
    return np.where(d > 0, np.sqrt(d.astype(float)) * (1 + 1e-9) + 1e-6, 0.0)


def assign(x: np.ndarray, state: State, centroids: np.ndarray, shift: np.ndarray) -> np.ndarray:
    """Bring the state up to centroids that have moved by `shift`. Returns how many centroids
    were looked at for each vector."""
    state.upper += shift[state.cluster]
    state.low -= shift[state.near]
    state.rest -= shift.max(initial=0)
    bounds = state.low.shape[1]
    # beyond[:, z]: what all but the own and the first z next centroids are away at least.
    beyond = np.minimum.accumulate(np.column_stack([state.low, state.rest])[:, ::-1], axis=1)[:, ::-1]
    looked = np.zeros(len(x), np.int64)
    room = 1e-6
    open_ = np.flatnonzero(state.upper + room >= beyond[:, 0])
    if len(open_):
        own = ((x[open_] - centroids[state.cluster[open_]]) ** 2).sum(axis=1)
        state.upper[open_] = np.sqrt(own.astype(float))
        looked[open_] = 1
        open_ = open_[state.upper[open_] + room >= beyond[open_, 0]]
    enough = (state.upper[open_, None] + room < beyond[open_]).argmax(axis=1)
    for z in range(1, bounds + 1):
        rows = open_[enough == z]
        if not len(rows):
            continue
        which = np.column_stack([state.cluster[rows], state.near[rows, :z]])
        d = ((x[rows, None, :] - centroids[which]) ** 2).sum(axis=2)
        order = np.lexsort((which, d), axis=1)
        which = np.take_along_axis(which, order, axis=1)
        far = np.sqrt(np.take_along_axis(d, order, axis=1).astype(float))
        state.cluster[rows], state.upper[rows] = which[:, 0], far[:, 0]
        state.near[rows, :z], state.low[rows, :z] = which[:, 1:], far[:, 1:]
        looked[rows] = z + 1
    rows = open_[enough == 0]  # no bound certifies
    if len(rows):
        new = scan(x[rows], centroids, bounds)
        state.cluster[rows], state.upper[rows], state.near[rows], state.low[rows], state.rest[rows] = new.cluster, new.upper, new.near, new.low, new.rest
        looked[rows] = len(centroids)
    return looked


STATE = "vec_id BIGINT, v ARRAY<INT>, cluster INT, upper DOUBLE, near ARRAY<INT>, low ARRAY<DOUBLE>, rest DOUBLE, looked INT"


def _state_batch(ids: pa.Array, x: np.ndarray, s: State, looked: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [ids, lists(x), pa.array(s.cluster, pa.int32()), pa.array(s.upper), lists(s.near), lists(s.low, pa.float64()), pa.array(s.rest), pa.array(looked, pa.int32())],
        names=["vec_id", "v", "cluster", "upper", "near", "low", "rest", "looked"],
    )


def _matrix(column: pa.Array, rows: int) -> np.ndarray:
    return np.array(column.flatten()).reshape(rows, -1)


def _first_round(rows: DataFrame, centroids: np.ndarray, opt: KMeansOptions) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, at = scaled(batch.column(1), opt.scale, opt.dimensions)
            yield _state_batch(batch.column(0).cast(pa.int64()).take(pa.array(at)), x, scan(x, centroids, bounds), np.full(len(x), len(centroids)))

    bounds = max(0, min(opt.bounds, len(centroids) - 1))
    return rows.select("vec_id", "embedding").mapInArrow(frugal(run), STATE)


def _next_round(state: DataFrame, centroids: np.ndarray, shift: np.ndarray) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            x = _matrix(batch.column(1), len(batch)).astype(np.int64)
            s = State(np.array(batch.column(2)).astype(np.int64), np.array(batch.column(3)), _matrix(batch.column(4), len(batch)).astype(np.int64), _matrix(batch.column(5), len(batch)), np.array(batch.column(6)))
            looked = assign(x, s, centroids, shift)
            yield _state_batch(batch.column(0), x, s, looked)

    return state.mapInArrow(frugal(run), STATE)


def _moved_centroids(state: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Each cluster's exact floor(sum / count); empty ones stay. Tasks add up their vectors,
    the sums of components meet by cluster and component."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros_like(centroids), np.zeros(len(centroids), np.int64)
        for batch in batches:
            if len(batch):
                cluster = np.asarray(batch.column(0))
                np.add.at(total, cluster, _matrix(batch.column(1), len(batch)).astype(np.int64))
                n += np.bincount(cluster, minlength=len(n))
        some = np.flatnonzero(n)
        # The count goes as one more component.
        sums = np.column_stack([total[some], n[some]])
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), lists(sums, pa.int64())], names=["cluster", "sums"])

    parts = state.select("cluster", "v").mapInArrow(frugal(add), "cluster INT, sums ARRAY<BIGINT>").select("cluster", F.posexplode("sums").alias("at", "x"))
    sums = np.zeros((len(centroids), centroids.shape[1] + 1), np.int64)
    for r in parts.groupBy("cluster", "at").agg(F.sum("x").alias("x")).collect():  # clusters x dimensions
        sums[r["cluster"], r["at"]] = r["x"]
    n = sums[:, -1:]
    return np.where(n > 0, sums[:, :-1] // np.maximum(n, 1), centroids)


def cluster_vectors(rows: DataFrame, opt: KMeansOptions = KMeansOptions()) -> DataFrame:
    """K-means with fixed rounds over rows of vec_id and embedding; other columns are ignored,
    whatever their names. One row per kept vector: vec_id, cluster, distance (squared),
    cluster_inertia, inertia, centroid_sha256, looked (centroids that the last assignment
    looked at).

    Kept are vectors with exactly `dimensions` components, none null or non-finite, in integers
    floor(scale * x); components from 2^27 after scaling raise an error. Centroids start as
    the kept vectors with smallest SHA-256 of `<seed>:<vec_id>`, a null id as the empty text,
    equal hashes by the vector; with fewer vectors than clusters there are fewer clusters.
    Repeated rows count each. Ties go to the smaller cluster number. An empty table, or one
    without a vector to keep, gives no rows.
    """
    spark = rows.sparkSession
    small_batches(spark)
    x = F.col("embedding")
    finite = F.forall(x, lambda e: e.isNotNull() & (e < float("inf")) & (e > float("-inf")))
    kept = rows.select("vec_id", "embedding").filter(x.isNotNull() & (F.size(x) == opt.dimensions) & finite)
    key = F.sha2(F.concat(F.lit(f"{opt.seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))).cast("binary"), 256)
    drawn = kept.orderBy(key, "embedding").limit(opt.clusters).toArrow()
    centroids, _ = scaled(drawn.column("embedding").combine_chunks(), opt.scale, opt.dimensions)
    if not len(centroids):
        return spark.createDataFrame([], "vec_id BIGINT, cluster INT, distance BIGINT, cluster_inertia BIGINT, inertia BIGINT, centroid_sha256 STRING, looked INT")
    state = written(_first_round(kept, centroids, opt), "kmeans")
    for _ in range(opt.rounds):
        after = _moved_centroids(state, centroids)
        before, state = state, written(_next_round(state, after, moved(centroids, after)), "kmeans")
        drop_written(before)
        centroids = after

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                far = ((_matrix(batch.column(1), len(batch)) - centroids[np.asarray(batch.column(2))]) ** 2).sum(axis=1)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(far, pa.int64()), batch.column(3)], names=["vec_id", "cluster", "distance", "looked"])

    found = state.select("vec_id", "v", "cluster", "looked").mapInArrow(frugal(measure), "vec_id BIGINT, cluster INT, distance BIGINT, looked INT")
    found = written(found, "clusters")
    drop_written(state)
    sums = {r["cluster"]: r["n"] for r in found.groupBy("cluster").agg(F.sum("distance").alias("n")).collect()}  # a row for each cluster
    total = sum(sums.values())
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    told = spark.createDataFrame([(k, n, total, names[k]) for k, n in sums.items()], "cluster INT, cluster_inertia BIGINT, inertia BIGINT, centroid_sha256 STRING")
    return found.join(F.broadcast(told), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "looked")


def op13_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster_vectors(table(spark, sf_dir, "embeddings")).drop("looked")


def _sql(rounds: int) -> str:
    ctes = [
        """kept AS (
  SELECT row_number() OVER () AS r, vec_id, embedding, list_transform(embedding, lambda e: floor(64 * e::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE len(embedding) = 64 AND list_bool_and(list_transform(embedding, lambda e: coalesce(isfinite(e), false)))
)""",
        """c0 AS (
  SELECT row_number() OVER (ORDER BY sha256('1:' || coalesce(vec_id::VARCHAR, '')), embedding) - 1 AS k, v FROM kept QUALIFY k < 16
)""",
    ]
    for i in range(rounds + 1):
        ctes.append(f"""a{i} AS (
  SELECT r, k, d FROM (
    SELECT r, k, list_sum(list_transform(list_zip(kept.v, c{i}.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d FROM kept, c{i}
  ) QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, k) = 1
)""")
        if i < rounds:
            ctes.append(f"""c{i + 1} AS (
  SELECT k, coalesce(m.v, c{i}.v) AS v FROM c{i} LEFT JOIN (
    SELECT k, list((s - ((s % n) + n) % n) // n ORDER BY j) AS v FROM (
      SELECT k, j, sum(v[j])::BIGINT AS s, count(*) AS n FROM a{i} JOIN kept USING (r), range(1, 65) AS g(j) GROUP BY k, j
    ) GROUP BY k
  ) AS m USING (k)
)""")
    return "WITH " + ",\n".join(ctes) + f"""
SELECT vec_id, k::INTEGER AS cluster, d AS distance, (sum(d) OVER (PARTITION BY k))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia,
  sha256(array_to_string(c{rounds}.v, ',')) AS centroid_sha256
FROM a{rounds} JOIN kept USING (r) JOIN c{rounds} USING (k)
"""


SQL = _sql(KMeansOptions.rounds)
