"""Mixing sources to target weights by a low-discrepancy schedule.

Targets are closed-form water filling over the sources. Each source's documents are
shuffled by a hash and laid end to end, and the tape is cut into blocks of equal token
count. Slots are the points of the golden-ratio sequence mapped through the cumulative
targets; the rank of a slot among those of its source names the block that it takes, going
round the tape again when it ends. Joining slots and blocks gives the mix.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from drawlake.llm.common import frequent_keys, table, words_of, written

GOLDEN = 0.6180339887498949
#: Weights of the sources in their order, repeating.
WEIGHTS = (5, 2, 1)
MOST_SOURCES = 1_000_000


@dataclass(frozen=True)
class MixOptions:
    weights: tuple[int, ...] = WEIGHTS
    share: float = 1.0  # of all sizes, that the mix takes
    most_repeats: int = 3
    block: int = 256  # tokens of a block
    chunk: int = 4096  # documents, or slots, that are ordered by one task at a time


def source_targets(sized: DataFrame, opt: MixOptions) -> DataFrame:
    """source, source_size, target, share_end for every source; null is a source and comes last.

    Water filling: sources in ascending order of cap over weight stop at their cap while the
    level that the others would get is above it. One row per source goes through a single task.
    """
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    order = W.orderBy(F.col("source").asc_nulls_last())
    picks = F.array(*[F.lit(w) for w in opt.weights])
    ranked = sizes.withColumn("rank", F.row_number().over(order).cast("bigint")).withColumn(
        "weight", F.element_at(picks, (F.pmod(F.col("rank") - 1, F.lit(len(opt.weights))) + 1).cast("int")).cast("bigint")
    )
    cap = opt.most_repeats * F.col("source_size")
    by = [F.col("source_size") / F.col("weight"), F.col("rank")]
    upto = W.orderBy(*by).rowsBetween(W.unboundedPreceding, -1)
    down = W.orderBy(*by).rowsBetween(0, W.unboundedFollowing)
    everything = W.orderBy(*by).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    levels = (
        ranked.withColumn("total", F.sum("source_size").over(everything) * opt.share)
        .withColumn("level", (F.col("total") - F.coalesce(F.sum(cap).over(upto), F.lit(0))) / F.sum("weight").over(down))
        .withColumn("free", F.col("level") * F.col("weight") <= cap)
    )
    # The first source that stays below its cap sets the level of all that follow it.
    first = W.orderBy(*by).rowsBetween(W.unboundedPreceding, 0)
    set_level = F.first(F.when(F.col("free"), F.col("level")), ignorenulls=True).over(first)
    return levels.withColumn("set_level", set_level).select(
        "source", "rank", "source_size", "n_docs",
        F.when(F.col("set_level").isNull(), cap.cast("double")).otherwise(F.least(cap.cast("double"), F.col("set_level") * F.col("weight"))).alias("target"),
    )


CELLS = 1024


def schedule(spark: SparkSession, targets: DataFrame | list, opt: MixOptions) -> DataFrame:
    """Slots of the mix in order: slot, rank (of the source), turn (rank of the slot among
    those of its source, from 0). targets: rank and target of each source.

    The points need no state, so any range of slots can be made anywhere. A point's source is
    the one whose interval of the cumulative targets holds it: both are dealt to CELLS cells, so
    that is an equality join with a recheck, whatever the number of sources. Turns come from
    counts per chunk of slots and a window within the chunk. A source gets a few points more
    or fewer than the blocks it needs; missing turns follow the last point.
    """
    if not isinstance(targets, DataFrame):
        targets = spark.createDataFrame([(t["rank"], float(t["target"])) for t in targets], "rank BIGINT, target DOUBLE")
    need = F.ceil(F.floor("target") / opt.block).cast("bigint")
    needed = targets.select(F.col("rank").cast("bigint").alias("rank"), need.alias("need"))
    # A row per source goes through a single task.
    upto = needed.withColumn("upto", F.sum("need").over(W.orderBy("rank").rowsBetween(W.unboundedPreceding, 0)))
    total = upto.agg(F.max("upto")).first()[0] or 0
    spans = upto.filter("need > 0").select("rank", ((F.col("upto") - F.col("need")) / total).alias("low"), (F.col("upto") / total).alias("high"))
    last = F.least(F.floor(F.col("high") * CELLS), F.lit(CELLS - 1).cast("bigint"))
    spans = spans.withColumn("cell", F.explode(F.sequence(F.floor(F.col("low") * CELLS), last)))
    points = spark.range(total).select(F.col("id").alias("slot"), F.pmod((F.col("id") + 1) * F.lit(GOLDEN), F.lit(1.0)).alias("u"))
    points = points.withColumn("cell", F.floor(F.col("u") * CELLS))
    slots = points.join(spans, "cell").filter("low <= u AND u < high").select("slot", "rank", F.floor(F.col("slot") / opt.chunk).alias("chunk"))
    slots = written(slots, "mix-slots")
    counts = slots.groupBy("rank", "chunk").agg(F.count(F.lit(1)).alias("n"))
    before = _running(counts, ["rank"], "chunk", "n", "before")
    within = W.partitionBy("rank", "chunk").orderBy("slot")
    turn = F.coalesce("before", F.lit(0)) + F.row_number().over(within) - 1
    drawn = slots.join(before, ["rank", "chunk"]).select("slot", "rank", turn.cast("bigint").alias("turn"))
    got = counts.groupBy("rank").agg(F.sum("n").alias("got"))
    short = needed.join(got, "rank", "left").withColumn("got", F.coalesce("got", F.lit(0).cast("bigint"))).filter("got < need")
    missing = short.select("rank", F.explode(F.sequence(F.col("got"), F.col("need") - 1)).alias("turn"))
    # A few rows per source, since the points are of low discrepancy.
    late = missing.withColumn("slot", F.row_number().over(W.orderBy("turn", "rank")) + F.lit(total - 1))
    return drawn.unionByName(late.select("slot", "rank", "turn"))


def _running(counts: DataFrame, keys: list[str], order: str, value: str, out: str, group: int = 1024) -> DataFrame:
    """Exclusive running sums in two levels, so that no task orders more than `group` rows
    or one row for each group of them."""
    c = counts.withColumn("_g", F.floor(F.col(order) / group))
    sums = c.groupBy(*keys, "_g").agg(F.sum(value).alias("_s"))
    sums = sums.withColumn("_b", F.coalesce(F.sum("_s").over(W.partitionBy(*keys).orderBy("_g").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_s")
    inner = W.partitionBy(*keys, "_g").orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    return c.join(sums, [*keys, "_g"]).select(*keys, order, (F.col("_b") + F.coalesce(F.sum(value).over(inner), F.lit(0))).alias(out))


def _order_keys(sized: DataFrame, opt: MixOptions) -> DataFrame:
    """Adds key, by which a tape is ordered: MD5 of the id. The few ids that hold a large share
    of all rows, none among them, would put those rows into one bucket; theirs is the MD5 of
    the text's hash too, and equal rows are counted and told apart by their number, so that
    reruns agree whatever order the rows come in."""
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    counts = sized.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    often = frequent_keys(counts.withColumn("name", name).select("name", "n"), "name", "n")
    full = counts.filter(F.col("n") > opt.chunk).select(name.alias("name"))  # more rows than a bucket has
    often = written(often.join(full, "name", "left_semi"), "frequent-ids")
    if not often.head(1):
        return sized.withColumn("key", F.md5(name.cast("binary"))).drop("_text")
    named = sized.withColumn("name", name)
    few = named.join(F.broadcast(often), "name", "left_anti").withColumn("key", F.md5(F.col("name").cast("binary"))).drop("_text", "name")
    equal = named.join(F.broadcast(often), "name", "left_semi").groupBy(*named.columns).agg(F.count(F.lit(1)).alias("n"))
    # Numbers in two steps, as one array of all would have no bound.
    block = F.lit(opt.chunk).cast("bigint")
    blocks = equal.withColumn("b", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("n") - 1) / block))))
    copies = blocks.withColumn("i", F.explode(F.sequence(F.col("b") * block, F.least((F.col("b") + 1) * block, F.col("n")) - 1)))
    many = copies.withColumn("key", F.md5(F.concat_ws(":", "name", "_text", "i").cast("binary")))
    return few.unionByName(many.select(*few.columns))


def tape(sized: DataFrame, targets: DataFrame, opt: MixOptions) -> DataFrame:
    """Where each document lies on its source's tape: doc_id, size, source columns, at.
    The order is by `_order_keys`, so reruns agree; the key's leading bits deal the
    documents of even the largest source to buckets of about opt.chunk documents."""
    d = _order_keys(sized, opt)
    d = d.join(F.broadcast(targets), d["source"].eqNullSafe(targets["source"])).drop(targets["source"])
    buckets = F.ceil(F.col("n_docs") / opt.chunk)
    d = d.withColumn("bucket", F.floor(F.conv(F.substring("key", 1, 8), 16, 10).cast("bigint") * buckets / F.lit(2**32)).cast("bigint"))
    sums = d.groupBy("rank", "bucket").agg(F.sum("size").alias("s"))
    before = _running(sums, ["rank"], "bucket", "s", "before")
    within = W.partitionBy("rank", "bucket").orderBy("key", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    out = d.withColumn("_in", F.coalesce(F.sum("size").over(within), F.lit(0)))
    return out.join(before, ["rank", "bucket"]).withColumn("at", F.col("before") + F.col("_in")).drop("_in", "before", "bucket", "key")


def _prepared(docs: DataFrame, opt: MixOptions, *keep: str) -> tuple[DataFrame, DataFrame]:
    """The documents on their tapes, and the slots with the part of the tape that each takes:
    slot, rank, turn, begin, length. The last slot of a source takes no more than the target
    leaves."""
    spark = docs.sparkSession
    sized = written(docs.select("doc_id", "source", F.size(words_of(F.col("text"))).cast("bigint").alias("size"), F.xxhash64("text").alias("_text"), *keep), "mix-sizes")
    targets = written(source_targets(sized, opt), "mix-targets")
    if (n := targets.count()) > MOST_SOURCES:  # a row per source is broadcast
        raise ValueError(f"{n} sources; at most {MOST_SOURCES} can be mixed")
    goal = F.floor("target").cast("bigint")
    # Places of rows that tie in the tape's order are chosen once.
    placed = written(tape(sized, targets, opt).withColumn("goal", goal), "mix-tape")
    slots = schedule(spark, targets, opt)
    turns = slots.join(F.broadcast(targets.select("rank", goal.alias("goal"))), "rank").withColumn("begin", F.col("turn") * opt.block)
    return placed, turns.select("slot", "rank", "turn", "begin", F.least(F.lit(opt.block), F.col("goal") - F.col("begin")).alias("length")).filter("length > 0")


def _drawn(placed: DataFrame, slots: DataFrame, opt: MixOptions) -> DataFrame:
    """Joins slots to blocks. A tape begins again every source_size tokens, and turn after
    turn takes the next block of it, so a document lies in the blocks of its place in every
    round; it is cut there and meets the one slot that has the block's source and turn."""
    lies = placed.filter("size > 0 AND at < goal")
    rounds = F.floor((F.col("goal") - 1 - F.col("at")) / F.col("source_size"))
    again = lies.withColumn("round", F.explode(F.sequence(F.lit(0).cast("bigint"), rounds))).withColumn("first", F.col("at") + F.col("round") * F.col("source_size"))
    last = F.least(F.col("first") + F.col("size"), F.col("goal")) - 1
    cut = again.withColumn("turn", F.explode(F.sequence(F.floor(F.col("first") / opt.block), F.floor(last / opt.block))))
    start = F.greatest(F.col("begin") - F.col("first"), F.lit(0))
    end = F.least(F.col("begin") + F.col("length") - F.col("first"), F.col("size"))
    return slots.join(cut, ["rank", "turn"]).withColumn("offset", F.greatest(F.col("first") - F.col("begin"), F.lit(0))).withColumn("start", start).withColumn("end", end)


def mixture(docs: DataFrame, opt: MixOptions = MixOptions(), *keep: str) -> DataFrame:
    """The mix: slot, offset (in the slot), source, block, round, doc_id, size, start, end and
    the columns to keep. Ordered by slot and offset, the words start to end (exclusive) of the
    documents are the mixed text. block counts the blocks of a source's tape from 0, going
    round it; round is how often the document has come before; at is its place on the tape.
    Odd rows are treated as by mix.
    """
    placed, slots = _prepared(docs, opt, *keep)
    return _drawn(placed, slots, opt).select("slot", "offset", "source", F.col("turn").alias("block"), "round", "at", "doc_id", "size", "start", "end", *keep)


def whole_documents(docs: DataFrame, opt: MixOptions = MixOptions()) -> DataFrame:
    """The rows of `docs` in the order of the mix, each as often as the mix takes it: in every
    round that takes at least half of its words, at the slot where the round begins it. Sources
    above their target so lose documents and those below it repeat theirs.

    Rows are told apart by two hashes of all their columns, whatever these are called; equal
    rows are interchangeable, so each comes as often as the mix takes them together. Null and
    blank texts have no words and are not taken. Null ids and null sources are values like
    any other. An empty table gives no rows.
    """
    columns = [F.col(f"`{c}`") for c in docs.columns]
    nulls = F.concat(*[c.isNull().cast("int").cast("string") for c in columns])
    print1, print2 = F.xxhash64(nulls, *columns).alias("print1"), F.xxhash64(F.lit("second"), nulls, *columns).alias("print2")
    drawn = mixture(docs.select("doc_id", "source", "text", print1, print2), opt, "print1", "print2")
    rounds = drawn.groupBy("print1", "print2", "source", "at", "round", "size").agg(
        F.sum(F.col("end") - F.col("start")).alias("words"), F.min(F.struct("slot", "offset")).alias("begin")
    )
    copies = rounds.filter("2 * words >= size").select("print1", "print2", "begin")
    rows = docs.select(print1, print2, F.struct(*columns).alias("row")).groupBy("print1", "print2").agg(F.first("row").alias("row"))
    out = rows.join(copies, ["print1", "print2"]).select("row", "begin").orderBy("begin")
    return out.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def mix(docs: DataFrame, opt: MixOptions = MixOptions()) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, taken (words in the mix).

    Null and blank texts have size 0 and take part with 0. A null source is a source of its
    own. More than MOST_SOURCES sources are an error. Rows that repeat a doc_id are documents of their own. Without any word in the table
    every target and every taken is 0. An empty table gives no rows; other columns are ignored.
    """
    placed, slots = _prepared(docs, opt)
    # Among documents with words no two have the same place.
    sums = _drawn(placed, slots, opt).groupBy(F.col("rank").alias("_rank"), F.col("at").alias("_at")).agg(F.sum(F.col("end") - F.col("start")).alias("_taken"))
    same = (F.col("rank") == F.col("_rank")) & (F.col("at") == F.col("_at")) & (F.col("size") > 0)
    return placed.join(sums, same, "left").select("doc_id", "source", "size", "source_size", "target", F.coalesce("_taken", F.lit(0)).cast("bigint").alias("taken"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


SQL = r"""
WITH d AS (SELECT doc_id, source, text, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
z AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM d GROUP BY source),
w AS (SELECT *, ([5, 2, 1])[(rank - 1) % 3 + 1] AS weight, sum(source_size) OVER () * 1.0::DOUBLE AS total FROM z),
l AS (SELECT *, (total - 3 * coalesce(sum(source_size) OVER (ORDER BY source_size / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY source_size / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
f AS (SELECT *, first_value(CASE WHEN level * weight <= 3 * source_size THEN level END IGNORE NULLS) OVER (ORDER BY source_size / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS set_level FROM l),
t AS (SELECT source, rank, source_size, CASE WHEN set_level IS NULL THEN 3.0::DOUBLE * source_size ELSE least(3.0::DOUBLE * source_size, set_level * weight) END AS target FROM f),
a AS (SELECT d.doc_id, d.size, t.source_size, t.target, CAST(floor(t.target) AS BIGINT) AS fin,
    coalesce(sum(d.size) OVER (PARTITION BY t.rank ORDER BY md5(coalesce(CAST(d.doc_id AS VARCHAR), '')), d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, CAST(fin // greatest(source_size, 1) * size + greatest(0, least(size, fin % greatest(source_size, 1) - pos)) AS BIGINT) AS taken FROM a
"""
