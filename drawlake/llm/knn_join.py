"""Exact top-k by inner product: a Voronoi join of queries and data.

With a further component sqrt(M^2 - |y|^2) for data, M their largest length, and 0 for queries,
a larger inner product is a smaller distance: d(q, y)^2 = |q|^2 + M^2 - 2 q.y. Pivots are fitted on a
bounded sample. A query belongs to the cell of its nearest pivot; scores against the sample give
it a score that its k-th answer reaches at least, hence a distance within which its answers lie.
A cell is summed up by its radius and by the largest of those distances. By the triangle
inequality a vector farther from the cell's pivot than both together answers no query of the
cell, so only the others are copied to it. Cells of few queries share a group, cells of many
are cut into several. Each group meets its data in chunks of bounded size, which give their
own best k; a ranking over those gives the answer.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from drawlake.llm.common import frugal, small_batches, table, written
from drawlake.llm.vectors import lists, products, scaled, widened


@dataclass(frozen=True)
class KnnOptions:
    top: int = 10
    scale: int = 1024
    pivots: int = 32
    sample: int = 1024  # vectors that pivots and first scores come from, fewer if they are long
    sample_numbers: int = 1 << 20
    group: int = 256  # queries that a task holds
    chunk_numbers: int = 1 << 19  # components of the data that a task holds: 8192 vectors of 64


@dataclass(frozen=True)
class Pivots:
    """Pivots in the space with the further component, which comes last."""

    at: np.ndarray
    reach: float  # M^2

    def distances(self, rows: np.ndarray, data: bool) -> np.ndarray:
        """From rows to pivots. Queries have 0 as their further component."""
        width = self.at.shape[1] - 1
        x = widened(rows, width).astype(float)
        if x.shape[1] > width:
            raise ValueError("a vector is longer than all that were counted")
        square = (x * x).sum(axis=1)
        further = np.sqrt(np.maximum(self.reach - square, 0)) if data else np.zeros(len(x))
        cross = x @ self.at[:, :-1].T + further[:, None] * self.at[:, -1]
        own = square + further**2
        return np.sqrt(np.maximum(own[:, None] - 2 * cross + (self.at**2).sum(axis=1), 0))


def fit_pivots(sample: np.ndarray, reach: float, n: int) -> Pivots:
    """The first pivot is the first vector of the sample, each further one the vector farthest
    from all before; then five rounds move them to the means of their cells."""
    x = sample.astype(float)
    x = np.column_stack([x, np.sqrt(np.maximum(reach - (x * x).sum(axis=1), 0))])
    if not len(x):
        return Pivots(np.zeros((1, x.shape[1])), reach)
    at = x[:1]
    far = ((x - at[0]) ** 2).sum(axis=1)
    while len(at) < n and far.max() > 0:
        at = np.vstack([at, x[far.argmax()]])
        far = np.minimum(far, ((x - at[-1]) ** 2).sum(axis=1))
    for _ in range(5):
        cell = ((x * x).sum(axis=1)[:, None] - 2 * x @ at.T + (at * at).sum(axis=1)).argmin(axis=1)
        for k in range(len(at)):
            if (own := cell == k).any():
                at[k] = x[own].mean(axis=0)
    return Pivots(at, reach)


def best_rows(score: np.ndarray, ids: np.ndarray, null: np.ndarray, allowed: np.ndarray, top: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each row of scores the columns of its `top` allowed ones, equal ones by ascending
    id, null ids last."""
    for i in range(len(score)):
        at = np.flatnonzero(allowed[i])
        if len(at) > top:
            least = np.partition(score[i, at], len(at) - top)[len(at) - top]
            at = at[score[i, at] >= least]
        yield i, at[np.lexsort((ids[at], null[at], -score[i, at]))][:top]


def _ids(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.cast(pa.int64()).fill_null(0)), np.asarray(column.is_null())


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    lists_ = column.combine_chunks()
    sizes = np.asarray(lists_.value_lengths())
    width = int(sizes.max(initial=0))
    out = np.zeros((len(sizes), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = np.asarray(lists_.flatten())
    return out


VECTOR = "vec_id BIGINT, v ARRAY<INT>"


def _vectors(rows: DataFrame, scale: int) -> DataFrame:
    """Usable vectors in integers."""

    def turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v, at = scaled(batch.column(1), scale)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()).take(pa.array(at)), lists(v)], names=["vec_id", "v"])

    return rows.select("vec_id", "embedding").mapInArrow(frugal(turn), VECTOR)


def _sizes(rows: DataFrame, scale: int) -> tuple[int, int, int]:
    """Number of usable vectors, most components and largest squared length."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v, at = scaled(batch.column(0), scale)
            square = (v.astype(float) ** 2).sum(axis=1).max(initial=0)
            yield pa.RecordBatch.from_pydict({"n": [len(at)], "d": [v.shape[1]], "s": [float(square)]})

    r = rows.select("embedding").mapInArrow(measure, "n BIGINT, d BIGINT, s DOUBLE").agg(F.sum("n").alias("n"), F.max("d").alias("d"), F.max("s").alias("s")).first()
    return r["n"] or 0, r["d"] or 0, r["s"] or 0.0


def top_products(rows: DataFrame, is_query: Column, opt: KnnOptions = KnnOptions()) -> DataFrame:
    """For each query row its `top` candidates by integer inner product: query_id, rank,
    vec_id, score.

    rows: vec_id, embedding (array of a floating type); other columns are ignored, whatever
    their names. Components become floor(scale * x). Vectors that are null or hold a null or
    non-finite component are neither queries nor candidates. Candidates of a query are all rows
    with another id or none; equal scores go by ascending vec_id, null ids last. A candidate
    row that is repeated is a candidate each time; query rows that repeat id and vector are one
    query, with other vectors each is ranked for itself. A shorter vector counts as ended by
    zeros; one of more than 2^14 components, or components from 2^27 after scaling, raise an
    error. With fewer candidates than `top` there are as many rows; an empty table gives none.
    """
    spark = rows.sparkSession
    small_batches(spark)
    n, width, square = _sizes(rows, opt.scale)
    # A little more than any squared length, which is in floating point here.
    reach = square * (1 + 1e-9) + 1
    most = max(1, min(opt.sample, opt.sample_numbers // max(width, 1)))
    usable = rows.select("vec_id", "embedding").filter(F.col("embedding").isNotNull())
    drawn = _vectors(usable.orderBy(F.xxhash64("embedding", "vec_id"), "vec_id").limit(most), opt.scale).toArrow()
    sample, (sample_id, sample_null) = widened(_matrix(drawn.column("v")), width), _ids(drawn.column("vec_id"))
    pivots = fit_pivots(sample, reach, opt.pivots)
    # Bounded: `sample_numbers` numbers and fewer pivots than that.
    shared = spark.sparkContext.broadcast((pivots, sample, sample_id, sample_null))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots, sample, sample_id, sample_null = shared.value
        for batch in batches:
            v = widened(_matrix(pa.chunked_array([batch.column(2)])), width)
            far = pivots.distances(v, data=False)
            cell = far.argmin(axis=1)
            within = np.full(len(v), np.inf)
            allowed = (sample_id != np.asarray(batch.column(1))[:, None]) | sample_null
            enough = allowed.sum(axis=1) >= opt.top
            if enough.any():
                score = np.where(allowed[enough], products(v[enough], sample), np.iinfo(np.int64).min)
                kth = np.partition(score, score.shape[1] - opt.top, axis=1)[:, score.shape[1] - opt.top]
                within[enough] = np.sqrt(np.maximum((v[enough].astype(float) ** 2).sum(axis=1) + pivots.reach - 2.0 * kth, 0))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32()), pa.array(far[np.arange(len(v)), cell]), pa.array(within)], names=["query", "query_id", "v", "cell", "far", "within"])

    asked = _vectors(usable.filter(is_query), opt.scale).distinct()
    # Numbers are written, so that they stay the same when a task is run again.
    asked = written(asked.select(F.monotonically_increasing_id().alias("query"), F.col("vec_id").alias("query_id"), "v"), "queries")
    queries = written(asked.mapInArrow(frugal(place), "query BIGINT, query_id BIGINT, v ARRAY<INT>, cell INT, far DOUBLE, within DOUBLE"), "queries")
    # A row for each pivot.
    cells = {r["cell"]: r for r in queries.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("radius"), F.max("within").alias("within")).collect()}
    if not cells:
        return spark.createDataFrame([], "query_id BIGINT, rank INT, vec_id BIGINT, score BIGINT")
    first, parts, n_groups = grouped(pivots.at, {k: r["n"] for k, r in cells.items()}, opt.group)
    n_chunks = max(1, -(-n * max(width, 1) // opt.chunk_numbers))
    bounds = spark.sparkContext.broadcast((pivots, sorted((k, r["radius"] + r["within"], first[k], parts[k]) for k, r in cells.items())))

    def copies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots, cells = bounds.value
        turn = TaskContext.get().partitionId()
        for batch in batches:
            v, at = scaled(batch.column(1), opt.scale)
            far = pivots.distances(v, data=True)
            wanted = np.zeros((len(v), n_groups), bool)
            for cell, bound, begin, n_parts in cells:
                # Rounding of distances must not lose an answer.
                wanted[:, begin : begin + n_parts] |= (far[:, cell] <= bound * (1 + 1e-9) + 1e-3)[:, None]
            row, group = np.nonzero(wanted)
            chunk = (turn + row) % n_chunks
            turn += len(v)
            for i in range(0, len(row), 8192):
                r = row[i : i + 8192]
                yield pa.RecordBatch.from_arrays([pa.array(group[i : i + 8192], pa.int32()), pa.array(chunk[i : i + 8192], pa.int64()), batch.column(0).cast(pa.int64()).take(pa.array(at[r])), lists(v[r])], names=["group", "chunk", "vec_id", "v"])

    data = usable.mapInArrow(frugal(copies), "group INT, chunk BIGINT, vec_id BIGINT, v ARRAY<INT>")
    group_of = F.create_map(*[F.lit(x) for k in sorted(first) for x in (k, first[k])])
    parts_of = F.create_map(*[F.lit(x) for k in sorted(parts) for x in (k, parts[k])])
    own = group_of[F.col("cell")] + F.pmod(F.hash("query"), parts_of[F.col("cell")])
    sent = queries.withColumn("group", own.cast("int")).withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n_chunks - 1).cast("bigint"))))
    sent = sent.select("group", "chunk", "query", "query_id", "v", "within")

    def solve(queries: pa.Table, data: pa.Table) -> pa.Table:
        q, s = _matrix(queries.column("v")), _matrix(data.column("v"))
        query, _ = _ids(queries.column("query"))
        query_id, _ = _ids(queries.column("query_id"))
        ids, null = _ids(data.column("vec_id"))
        out: list[list[np.ndarray]] = [[], [], [], []]
        for begin in range(0, len(q) if len(s) else 0, 64):
            part = slice(begin, begin + 64)
            score = products(q[part], s)
            for i, at in best_rows(score, ids, null, (ids != query_id[part, None]) | null, opt.top):
                k = begin + i
                for column, x in zip(out, (np.full(len(at), query[k]), np.full(len(at), query_id[k]), at, score[i, at]), strict=True):
                    column.append(x)
        query_, query_id_, at, score_ = (np.concatenate(c) if c else np.empty(0, np.int64) for c in out)
        return pa.table({"query": query_, "query_id": query_id_, "vec_id": pa.array(ids[at], pa.int64(), mask=null[at]), "score": score_})

    found = sent.groupBy("group", "chunk").cogroup(data.groupBy("group", "chunk")).applyInArrow(solve, "query BIGINT, query_id BIGINT, vec_id BIGINT, score BIGINT")
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= opt.top).select("query_id", "rank", "vec_id", "score")


def grouped(at: np.ndarray, n: dict[int, int], most: int) -> tuple[dict[int, int], dict[int, int], int]:
    """First group and number of groups of each cell, and the number of all. Cells are taken
    from one to its nearest; those that together hold at most `most` queries share a group, a
    cell of more has groups of its own."""
    first, parts, used, load = {}, {}, 0, 0
    left, now = set(n), min(n)
    while left:
        if now != min(n) or len(left) < len(n):
            now = min(left, key=lambda k: (((at[k] - at[now]) ** 2).sum(), k))
        left.discard(now)
        parts[now] = max(1, -(-n[now] // most))
        if load and (parts[now] > 1 or load + n[now] > most):
            used, load = used + 1, 0
        first[now] = used
        if parts[now] > 1:
            used += parts[now]
        else:
            load += n[now]
    return first, parts, used + bool(load)


def op12_exact_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_products(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


SQL = """
WITH x AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda e: floor(1024 * e::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND list_bool_and(list_transform(embedding, lambda e: coalesce(isfinite(e), false)))
), q AS (
  SELECT row_number() OVER () AS query, vec_id AS query_id, v AS qv FROM (SELECT DISTINCT vec_id, v FROM x WHERE vec_id % 100 = 0)
), s AS (
  SELECT query, query_id, vec_id, list_sum(list_transform(list_zip(qv, v), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM q JOIN x ON vec_id IS DISTINCT FROM query_id
), ranked AS (
  SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id NULLS LAST) AS rank FROM s
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM ranked WHERE rank <= 10
"""
