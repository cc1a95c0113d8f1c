"""Line dedup over levelled sorted runs of line hashes.

A run is a table of line keys (two 64-bit hashes), bucketed and sorted by them,
with the number of documents that hold the key and the largest document id among
them. A new batch of lines is summed by key and merge-anti-joined with every
run: keys that none has are the batch's own run at level 0; of the others only
the repeats (key, documents, largest id) are put aside. When a level has `fanout`
runs they are merged into one of the next level; their keys are different, so
merging is no summing. So n batches keep O(log n) runs and each key is rewritten
O(log n) times. spent() adds the repeats to the runs' keys: those in `least_docs`
documents or more, and the document that keeps each.

Runs and a batch's sums are dealt by the same buckets, so the joins with runs
need no exchange of a run, and no sort of it.

Native: DataFrame functions only. Line texts are never shuffled for their own
sake, only 128-bit keys and places; texts move once, to meet the places that
they lose (not at all if those are few enough to broadcast). A key and
document is dealt by both, and sums by key are partial before they are dealt by
key, so a line that a third of all documents hold is one row from each task. Runs
are merged bucket by bucket, without an exchange. The join with spent keys has
plain scans on both sides, which Spark splits where it is skewed.

Defined results: a null or empty text is one empty line, kept; a document is
its doc_id: rows of one id count as one document and each lose the same lines;
a row with a null id is counted nowhere and stays whole; equal lines within
the largest document all stay; an empty table gives no row; further columns
stay, but for those that have the name of an added one, which are replaced.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, forget, removed, scratch_root, table, written

LEAST_CHARS, LEAST_DOCS, BATCHES, FANOUT = 20, 3, 4, 2


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(" \t\n\x0b\x0c\r")))


def lines_of(text: str = "text") -> Column:
    return F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)


def text_hash() -> Column:
    """Tells rows of one id with different texts apart."""
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")), F.lit("row"))


def keyed_lines(docs: DataFrame, least_chars: int = LEAST_CHARS, batches: int = BATCHES) -> DataFrame:
    """(doc_id, text_hash, pos, h1, h2, batch) of the lines whose key is long
    enough."""
    rows = docs.where("doc_id is not null").select("doc_id", text_hash().alias("text_hash"), F.posexplode(F.transform(lines_of(), line_key)).alias("pos", "key"))
    rows = rows.where(F.length("key") >= least_chars)
    return rows.select("doc_id", "text_hash", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("line"), "key").alias("h2"), F.pmod(F.xxhash64("doc_id"), F.lit(batches)).cast("int").alias("batch"))


KEY = ["h1", "h2"]
#: A bucket is one sorted file: scans of runs stay by bucket, and their order is relied on.
BUCKETS = {"spark.sql.legacy.bucketedTableScan.outputOrdering": "true", "spark.sql.sources.bucketing.autoBucketedScan.enabled": "false"}


def summed(lines: DataFrame) -> DataFrame:
    """(h1, h2, docs, top): each key's documents and the largest id among them. A
    document's key is dealt once by both; then each task's sums are dealt by key."""
    once = lines.select("doc_id", *KEY).distinct()
    return once.groupBy(*KEY).agg(F.count("*").alias("docs"), F.max("doc_id").alias("top"))


class LineRuns:
    """The runs of a store, by level, and the repeats of their keys. A document's
    lines must all be in one batch. close() forgets the tables."""

    def __init__(self, spark: SparkSession, fanout: int = FANOUT):
        self.spark, self.fanout = spark, fanout
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []
        self.repeats: list[DataFrame] = []
        self.scratch: list[tuple[str, str]] = []
        self.before = {key: spark.conf.get(key) for key in BUCKETS}
        for key, value in BUCKETS.items():
            spark.conf.set(key, value)

    def close(self) -> None:
        for key, value in self.before.items():
            self.spark.conf.set(key, value)
        for name, path in self.scratch:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            removed(self.spark, path)

    def runs(self) -> list[DataFrame]:
        return [self.spark.table(name) for level in self.levels for name in level]

    def stored(self, keys: DataFrame, kind: str) -> str:
        """Writes keys, dealt by KEY, as a bucketed table; its name."""
        name = f"{kind}_{uuid.uuid4().hex}"
        path = f"{scratch_root(self.spark)}/{name}"
        keys.write.bucketBy(self.buckets, *KEY).sortBy(*KEY).option("path", path).saveAsTable(name)
        self.scratch.append((name, path))
        return name

    def fresh(self, keys: DataFrame) -> DataFrame:
        """Those of keys that no run has."""
        return reduce(lambda rest, run: rest.join(run.hint("merge"), KEY, "left_anti"), self.runs(), keys)

    def add(self, lines: DataFrame) -> DataFrame:
        """Adds the run of a batch of (doc_id, h1, h2), and compacts. Returns the
        batch's keys that were new."""
        keys = summed(lines)
        if self.levels:
            keys = self.spark.table(self.stored(keys, "batch"))
        new = self.stored(self.fresh(keys), "run")
        if self.levels:
            known = [keys.join(run.select(*KEY).hint("merge"), KEY, "left_semi") for run in self.runs()]
            self.repeats.append(written(reduce(DataFrame.unionByName, known), "repeats"))
        self.put(0, new)
        return self.spark.table(new)

    def put(self, level: int, name: str) -> None:
        if len(self.levels) == level:
            self.levels.append([])
        self.levels[level].append(name)
        if len(self.levels[level]) >= self.fanout:
            done, self.levels[level] = self.levels[level], []
            self.put(level + 1, self.stored(reduce(self.merged, map(self.spark.table, done)), "run"))

    def merged(self, one: DataFrame, other: DataFrame) -> DataFrame:
        """Two runs as one, bucket by bucket as they lie; their keys are different."""
        both = one.join(other.select(*KEY, F.col("docs").alias("docs2"), F.col("top").alias("top2")).hint("merge"), KEY, "full_outer")
        return both.select(*KEY, F.coalesce("docs", "docs2").alias("docs"), F.coalesce("top", "top2").alias("top"))

    def spent(self, least_docs: int = LEAST_DOCS) -> DataFrame:
        """(h1, h2, top): keys in at least that many documents, over all runs."""
        if not self.repeats:
            return reduce(DataFrame.unionByName, self.runs()).where(F.col("docs") >= least_docs).select(*KEY, "top")
        again = reduce(DataFrame.unionByName, self.repeats).groupBy(*KEY).agg(F.sum("docs").alias("more"), F.max("top").alias("later"))
        again = self.spark.table(self.stored(again, "again"))
        found = [run.join(again.hint("merge"), KEY, "left").where(F.col("docs") + F.coalesce("more", F.lit(0)) >= least_docs).select(*KEY, F.greatest("top", "later").alias("top")) for run in self.runs()]
        return reduce(DataFrame.unionByName, found)


def line_dedup(docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS, batches: int = BATCHES, fanout: int = FANOUT, names: tuple[str, str, str] = ("n_lines", "n_dropped", "kept_text")) -> DataFrame:
    """docs with the columns `names` added: lines, lines dropped, the text left."""
    lines = written(keyed_lines(docs, least_chars, batches), "lines", "batch")
    runs = LineRuns(docs.sparkSession, fanout)
    try:
        for k in range(batches):
            runs.add(lines.where(F.col("batch") == k))
        spent = written(runs.spent(least_docs), "spent")
    finally:
        runs.close()
    drops = lines.join(spent, KEY).where("doc_id <> top").groupBy(F.col("doc_id").alias("drop_doc"), F.col("text_hash").alias("drop_hash")).agg(F.collect_list("pos").alias("drop_pos"))
    drops = written(drops, "drops")
    forget(lines, spent)
    own = [c for c in docs.columns if c not in names]
    hashed = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").alias("drop_doc"), text_hash().alias("drop_hash"))
    found = hashed.join(drops, ["drop_doc", "drop_hash"], "left")
    found = found.select("row", F.split(F.coalesce(F.col("row.text"), F.lit("")), "\n", -1).alias("lines"), F.coalesce("drop_pos", F.array().cast("array<int>")).alias("pos"))
    kept = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("pos"))
    text = F.when(F.size("pos") == 0, F.coalesce(F.col("row.text"), F.lit(""))).otherwise(F.array_join(F.transform(kept, lambda p: F.get("lines", p)), "\n"))
    # apart from the input's own columns, whose names may be these
    found = found.select("row", F.struct(*(c.alias(n) for c, n in zip((F.size("lines").cast("long"), F.size("pos").cast("long"), text), names))).alias("made"))
    return found.select(*(F.col("row")[c].alias(c) for c in own), *(F.col("made")[c].alias(c) for c in names))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


ORACLE_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (
  SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines),
spent AS (
  SELECT key, max(doc_id) AS top FROM keyed WHERE length(key) >= 20
  GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
marked AS (
  SELECT k.doc_id, k.line, k.pos, s.key IS NOT NULL AND k.doc_id <> s.top AS dropped
  FROM keyed k LEFT JOIN spent s ON k.key = s.key AND length(k.key) >= 20)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
