"""Secrets in versioned texts by an incremental blob ledger.

Every version of every path is content-addressed by the SHA-256 of its text. The ledger
holds a row for each pair of blob and rule version that has been scanned. A run scans only
the pairs that the ledger lacks, one representative text per blob, appends what it found,
and joins findings back to every path that carries the blob.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from drawlake.llm.common import frequent_keys, shared_dir, table, written

#: The base rules of the contract. kind: pattern, group whose length counts, least length.
BASE_RULES = {
    "assign": (r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    "access": (r"AKIA[A-Z0-9]+", 0, 20),
    "hex": (r"[0-9a-f]+", 0, 24),
}
#: Rules beyond the base ones.
MORE_RULES = {
    "private_key": (r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
    "jwt": (r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 30),
    "forge_token": (r"gh[pousr]_[A-Za-z0-9]+", 0, 24),
}
RULES = BASE_RULES | MORE_RULES
#: What a text must contain before a rule is tried on it.
NEEDED = {"assign": ("=", ":"), "access": ("AKIA",), "private_key": ("-----BEGIN",), "jwt": ("eyJ",), "forge_token": ("gh",)}
#: The rules name their version, so that findings of changed rules are never served for new ones.
RULE_VERSION = hashlib.sha256(repr([sorted(RULES.items()), list(RULES), sorted(NEEDED.items())]).encode()).hexdigest()[:16]
SPAN = "array<struct<kind:string,start:bigint,end:bigint>>"
LEDGER_SCHEMA = f"blob STRING, spans {SPAN}"


def running(numbers: Column) -> Column:
    """Sums of an array up to each place, in as many passes as its size has binary digits: each
    pass adds to every sum the one 1, 2, 4 ... places before it."""
    steps = F.sequence(F.lit(0), F.greatest(F.length(F.bin(F.size(numbers))), F.lit(1)) - 1)
    zero = F.lit(0).cast("bigint")

    def add(sums: Column, k: Column) -> Column:
        before = F.concat(F.array_repeat(zero, F.call_function("shiftleft", F.lit(1), k)), sums)
        return F.slice(F.zip_with(sums, before, lambda x, y: F.coalesce(x, zero) + y), F.lit(1), F.size(sums))

    return F.aggregate(steps, numbers, add)


def spans_of(text: Column, kind: str) -> Column:
    """Leftmost non-overlapping matches of a rule, as code point spans, without those that
    are too short. Starts follow from the lengths of what lies between the matches."""
    pattern, group, least = RULES[kind]
    quick = rf"[0-9a-f]{{{least},}}" if kind == "hex" else pattern  # whole runs match, so short runs can be left out at once
    lengths = lambda xs: F.transform(xs, F.length)
    between = lengths(F.split(text, quick, -1))
    whole = lengths(F.regexp_extract_all(text, F.lit(quick), F.lit(0)))
    value = lengths(F.regexp_extract_all(text, F.lit(quick), F.lit(group)))
    gaps = F.slice(between, F.lit(1), F.size(whole))
    ends = running(F.zip_with(gaps, whole, lambda gap, size: (gap + size).cast("bigint")))
    parts = F.filter(F.arrays_zip(ends.alias("end"), whole.alias("len"), value.alias("value")), lambda x: x["value"] >= least)
    spans = F.transform(parts, lambda x: F.struct(F.lit(kind).alias("kind"), (x["end"] - x["len"]).alias("start"), x["end"].alias("end")))

    possible = F.lit(True)
    if kind in NEEDED:
        possible = F.contains(text, F.lit(NEEDED[kind][0]))
        for more in NEEDED[kind][1:]:
            possible = possible | F.contains(text, F.lit(more))
    return F.when(possible & text.rlike(quick), spans).otherwise(F.array().cast(SPAN))


def scan(text: Column) -> Column:
    """All spans of a text by start, then by the order in which RULES lists the kinds."""
    order = F.create_map(*[x for i, k in enumerate(RULES) for x in (F.lit(k), F.lit(i))])
    keyed = F.transform(
        F.concat(*[spans_of(text, k) for k in RULES]),
        lambda s: F.struct(s["start"].alias("start"), order[s["kind"]].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind")),
    )
    return F.transform(F.array_sort(keyed), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))


class BlobLedger:
    """Scanned pairs of blob and rule version, under `path`. Each rule version has a table of
    its own that is bucketed and sorted by blob, so that a run reads the findings of its own
    version only and joins them without shuffling them."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    def _table(self, rule_version: str) -> tuple[str, str]:
        folder = f"{self.path}/rule_version={rule_version}"
        name = "blobs_" + hashlib.md5(folder.encode()).hexdigest()[:24]
        if not self.spark.catalog.tableExists(name):
            self.spark.sql(
                f"CREATE TABLE {name} ({LEDGER_SCHEMA}) USING parquet "
                f"CLUSTERED BY (blob) SORTED BY (blob) INTO {self.buckets} BUCKETS LOCATION '{folder}'"
            )
        return name, folder

    def rows(self) -> DataFrame:
        """All pairs: blob, spans, rule_version."""
        return self.spark.read.schema(LEDGER_SCHEMA + ", rule_version STRING").parquet(self.path)

    def known(self, rule_version: str) -> DataFrame:
        """Findings of a rule version by blob; a pair that two runs have appended counts once."""
        return self.spark.table(self._table(rule_version)[0]).groupBy("blob").agg(F.first("spans").alias("spans"))

    def add(self, found: DataFrame, rule_version: str) -> None:
        """Append findings (blob, spans)."""
        name, folder = self._table(rule_version)
        (
            found.repartition(self.buckets, "blob").write.mode("append").format("parquet").option("path", folder)
            .bucketBy(self.buckets, "blob").sortBy("blob").saveAsTable(name)
        )


def find_secrets(versions: DataFrame, ledger: BlobLedger, rule_version: str = RULE_VERSION) -> DataFrame:
    """One row per input row: doc_id, blob, spans (array of kind, start, end).

    `versions` has doc_id (the path) and text, a row for each historical version. A null
    text is an empty one and has no spans. Repeated rows are each answered; those that repeat
    both path and text of a representative are scanned each, and count once. A null doc_id is
    a path like any other. Very long texts are scanned whole. An empty table gives no rows;
    other columns are ignored.
    """
    blob = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("blob")
    paths = written(versions.select("doc_id", blob), "blob-paths")
    blobs = written(paths.groupBy("blob").agg(F.min("doc_id").alias("first_path"), F.count(F.lit(1)).alias("n")), "blobs")
    unseen = written(blobs.hint("merge").join(ledger.known(rule_version).select("blob").hint("merge"), "blob", "left_anti").select("blob", "first_path"), "unseen-blobs")
    # The copies of a frequent blob spread over many tasks, as the path is a part of the key.
    once = versions.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), blob).join(
        unseen.withColumnRenamed("blob", "b"), (F.col("blob") == F.col("b")) & F.col("doc_id").eqNullSafe(F.col("first_path")), "left_semi"
    )
    ledger.add(once.select("blob", scan(F.col("text")).alias("spans")), rule_version)
    known = ledger.known(rule_version)
    often = F.broadcast(written(frequent_keys(blobs, "blob", "n"), "frequent-blobs"))
    answers = F.broadcast(known.join(often, "blob", "left_semi"))
    found = paths.join(answers, "blob").unionByName(paths.join(often, "blob", "left_anti").hint("merge").join(known.hint("merge"), "blob"))
    return found.select("doc_id", "blob", "spans")


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents"), BlobLedger(spark, shared_dir(spark, "blob_ledger")))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE_RULES))
    return found.select(
        "doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"),
    )


def _sql() -> str:
    """DuckDB text: pieces between matches and the matches themselves give the positions."""
    plain = {
        "assign": "([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
        "[\"\\x27]?\\x20*[:=]\\x20*[\"\\x27]?([A-Za-z0-9+/_.=-]+)",
    }
    parts = []
    for rank, (kind, (pattern, group, least)) in enumerate(RULES.items()):
        p = plain.get(kind, pattern)
        parts.append(
            f"SELECT doc_id, '{kind}' AS kind, {rank} AS rank, unnest(range(1, len(m) + 1)) AS i, g, m, v, {least} AS least FROM ("
            f"SELECT doc_id, string_split_regex(text, '{p}') AS g, regexp_extract_all(text, '{p}', 0) AS m, regexp_extract_all(text, '{p}', {group}) AS v FROM t)"
        )
    kinds = ", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in BASE_RULES)
    base = ", ".join(f"'{k}'" for k in BASE_RULES)
    return f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
m AS ({" UNION ALL ".join(parts)}),
s AS (SELECT doc_id, kind, rank, list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0) AS s0,
        length(m[i]) AS n, length(v[i]) AS vn, least FROM m),
k AS (SELECT doc_id, kind, rank, CAST(s0 AS BIGINT) AS s0, concat(kind, ':', CAST(s0 AS BIGINT), ':', CAST(s0 + n AS BIGINT)) AS txt FROM s WHERE vn >= least),
a AS (SELECT doc_id, {kinds},
        coalesce(string_agg(txt, ',' ORDER BY s0, rank) FILTER (kind IN ({base})), '') AS base, string_agg(txt, ',' ORDER BY s0, rank) AS spans FROM k GROUP BY doc_id)
SELECT t.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM t LEFT JOIN a ON t.doc_id = a.doc_id
"""


SQL = _sql()
