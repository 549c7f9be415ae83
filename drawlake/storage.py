"""Tables between the steps of an operator, in the shared folder of the cluster, and the
connected components that need them."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession, label: str) -> str:
    """A new folder name under spark.checkpoint.dir. Where that is unset, a temporary folder
    becomes the checkpoint folder in a session of one machine; on a cluster, whose executors
    do not share one, that is an error."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not base:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="drawlake-")
        sc.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str = "rounds", codec: str = "zstd") -> DataFrame:
    """Cut the lineage: write to the shared folder and read back."""
    path = shared_dir(df.sparkSession, label)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def joinable(df: DataFrame, label: str = "rounds") -> DataFrame:
    """`written`, for a table that grows with its input and is joined: no join broadcasts it for
    the size of its files, as rows that take some bits there take a hundred bytes and more on the
    driver. Its joins are sort-merge joins, unless the other side is asked to be broadcast."""
    return written(df, label).hint("merge")


def drop_written(df: DataFrame) -> None:
    """Delete the folders that a table of `written` was read from, once it is not needed."""
    sc = df.sparkSession.sparkContext
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = sc._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def _state(edges: DataFrame) -> tuple:
    r = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(*edges.columns).cast("decimal(38,0)")).alias("h")).first()
    return r["n"], r["h"]


LOCAL_EDGES = 1 << 18  # of a graph that one task settles: 4 MB


def settled(edges: pa.Table, keys: tuple[str, ...]) -> pa.Table:
    """Components of one graph that fits in a task: keys, node, component."""
    both = np.column_stack([edges.column("u").to_numpy(), edges.column("v").to_numpy()])
    nodes, at = np.unique(both, return_inverse=True)
    root = list(range(len(nodes)))  # never above the node itself, so a root is its component's least

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in at.reshape(-1, 2).tolist():
        a, b = find(a), find(b)
        if a != b:
            root[max(a, b)] = min(a, b)
    least = nodes[np.array([find(x) for x in range(len(nodes))], np.int64)]
    first = pa.array(np.zeros(len(nodes), np.int64))
    return pa.table({k: edges.column(k).take(first) for k in keys} | {"node": nodes, "component": least})


def components(edges: DataFrame, *keys: str, most_rounds: int = 40, local: int = LOCAL_EDGES) -> DataFrame:
    """Connected components: graphs of at most `local` edges in one task each, larger ones by
    alternating large-star and small-star steps.

    edges: keys, u, v (bigint, any order, repeats allowed); edges of different keys are
    different graphs. Returns keys, node, component for every node with an edge to another
    one; component is the smallest node reachable. Every round is written to the shared
    folder, so a lost executor costs a part of one round, and the round before it is deleted;
    nothing but a count and a checksum reaches the driver. No edges give no rows.
    """
    high, low = F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")
    now = written(edges.filter(F.col("u") != F.col("v")).select(*keys, high, low).distinct(), "edges")
    types = dict(now.dtypes)
    schema = ", ".join([*(f"`{k}` {types[k]}" for k in keys), "node BIGINT", "component BIGINT"])
    small, large = now, None
    if keys:
        sizes = written(now.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > local).select(*keys), "large-graphs")
        if not sizes.isEmpty():
            same = [now[k].eqNullSafe(sizes[k]) for k in keys]
            small, large = now.join(sizes, same, "left_anti"), written(now.join(sizes, same, "left_semi"), "edges")
    elif now.count() > local:
        small, large = None, now
    done = []
    if small is not None:
        groups = small.groupBy(*keys) if keys else small.groupBy(F.lit(0).alias("_graph"))
        done.append(written(groups.applyInArrow(lambda t: settled(t, keys), schema), "components"))
    if large is not None:
        done.append(_by_stars(large, keys, most_rounds))
    if large is not now:
        drop_written(now)
    return done[0] if len(done) == 1 else done[0].unionByName(done[1])


def _by_stars(now: DataFrame, keys: tuple[str, ...], most_rounds: int) -> DataFrame:
    """Of a written table of edges, u above v, that is deleted after the first round."""
    before = None
    for _ in range(most_rounds):
        both = now.unionByName(now.select(*keys, F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy(*keys, "u").agg(F.min("v").alias("m")).select(*keys, "u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, [*keys, "u"]).select(*keys, F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        large = written(large, "edges")
        m = large.groupBy(*keys, "u").agg(F.min("v").alias("m"))
        small = large.join(m, [*keys, "u"]).filter("v != m").select(*keys, F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
        after = written(small.unionByName(m.withColumnRenamed("m", "v")).distinct(), "edges")
        drop_written(now)
        drop_written(large)
        now = after
        state = _state(now)
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"no fixed point after {most_rounds} rounds")
    roots = now.select(*keys, F.col("v").alias("node")).distinct()
    return now.select(*keys, F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots.withColumn("component", F.col("node")))
