"""Document fingerprints from closed syncmers.

A text is cut into pieces: runs of at most PIECE code points without white
space, counted from each word's start. A k-mer (K pieces) is a closed syncmer if
the least of the hashes of its inner substrings (S pieces each) is the first or
the last of them. That depends on nothing outside the k-mer, so two texts choose
the same anchors wherever they have the same pieces, and an edit moves no anchor
that it doesn't touch. At least one in K - S + 1 consecutive k-mers is chosen.

Anchors are matched by position: a feature is an anchor, the next one and the
distance between them, so two texts agree at a place only where both anchors are
in both texts and as far apart in each. A text of up to SHORT code points has too
few pieces for pairs to outlive an edit: its features are also the single
anchors of its code points, as pieces of one. The fingerprint of a text is the SKETCH
least distinct hashes of its features, as eight hex digits each; likeness is the
share of the least SKETCH of two fingerprints' union that is in both: exact for
texts with up to SKETCH features together, an estimate of the features'
resemblance beyond. sketch=None keeps all features, for exact likeness at any
length.

Native: arrays and higher-order functions over whole texts. For the next
document, ids are dealt by range and written, so that neighbours are found
within a range and over one row for each range; then each document asks its
next one for as many code points as it needs. The exchange of texts by id
serves the asked and the asking side; only those heads are moved besides.

Defined results: a null text is empty: no anchors, an empty fingerprint; two
empty fingerprints have likeness 1, an empty and a full one 0; a text of fewer
than K pieces has one anchor, all of it (of fewer than K code points, both ways); a null id sorts last (so does -2^63, which stands for it); rows of one id
are ordered by text hash, and repeated rows are one document, returned as often
as they are there; a single document is its own next; an empty table gives no
row; further columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, written

PIECE, K, S, SKETCH, SHORT = 3, 5, 2, 256, 96
#: Documents in a range, about, where each looks for the next one.
RANGE = 200_000
NO_ID = -(1 << 63)


def with_anchors(df: DataFrame, text: str, name: str, piece: int = PIECE, k: int = K, s: int = S) -> DataFrame:
    """df with `name`: array of struct(pos, hash), pos in pieces, in order."""
    w = k - s + 1
    t, inner, at = f"{name}_t", f"{name}_s", f"{name}_i"
    # elements one by one: slice() would copy the whole array at every place
    run = lambda of, i, n: [F.get(of, i + j) for j in range(n)]
    df = df.withColumn(t, F.transform(F.regexp_extract_all(text, F.lit(rf"[^\x20\x09-\x0D]{{1,{piece}}}"), 0), lambda x: F.xxhash64(x)))
    df = df.withColumn(inner, F.when(F.size(t) >= k, F.transform(F.sequence(F.lit(0), F.size(t) - s), lambda i: F.xxhash64(*run(t, i, s)))))
    chosen = lambda i: F.least(*run(inner, i, w)).isin(F.get(inner, i), F.get(inner, i + (w - 1)))
    df = df.withColumn(at, F.when(F.size(t) >= k, F.filter(F.sequence(F.lit(0), F.size(t) - k), chosen)))
    hashed = lambda i: F.struct(i.alias("pos"), F.xxhash64(*run(t, i, k)).alias("hash"))
    whole = F.when(F.size(t) > 0, F.array(F.struct(F.lit(0).alias("pos"), F.xxhash64(t).alias("hash")))).otherwise(F.array().cast("array<struct<pos:int,hash:bigint>>"))
    return df.withColumn(name, F.coalesce(F.transform(at, hashed), whole)).drop(t, inner, at)


def with_sketch(df: DataFrame, text: str, name: str, sketch: int | None = SKETCH, short: int = SHORT) -> DataFrame:
    """df with `name`: the least `sketch` distinct hashes of its features (None:
    all), 32 bits each, as signed integers. A text's last anchor stands alone."""
    a, brief, fine = f"{name}_a", f"{name}_b", f"{name}_f"
    df = with_anchors(df, text, a)
    df = with_anchors(df.withColumn(brief, F.when(F.length(text) <= short, F.col(text)).otherwise("")), brief, fine, piece=1)
    one, after = (lambda i: F.get(a, i)), (lambda i: F.get(a, i + 1))
    hashed = lambda *of: F.shiftright(F.xxhash64(*of), 32).cast("int")
    feature = lambda i: hashed(one(i)["hash"], F.coalesce(after(i)["hash"], F.lit(0)), F.coalesce(after(i)["pos"] - one(i)["pos"], F.lit(0)))
    features = F.when(F.size(a) > 0, F.transform(F.sequence(F.lit(0), F.size(a) - 1), feature)).otherwise(F.array().cast("array<int>"))
    # no pair is at such a distance
    single = F.transform(fine, lambda x: hashed(x["hash"], F.lit(0).cast("long"), F.lit(-1)))
    least = F.sort_array(F.array_distinct(F.concat(features, single)))
    return df.withColumn(name, least if sketch is None else F.slice(least, 1, sketch)).drop(a, brief, fine)


def fingerprint(sketch: str) -> Column:
    return F.array_join(F.transform(sketch, lambda x: F.lower(F.lpad(F.hex(x.cast("long").bitwiseAND(0xFFFFFFFF)), 8, "0"))), "")


def likeness(a: str, b: str, sketch: int | None = SKETCH) -> Column:
    both = F.sort_array(F.array_union(a, b))
    both = both if sketch is None else F.slice(both, 1, sketch)
    share = F.size(F.array_intersect(F.array_intersect(F.col(a), F.col(b)), both)) / F.size(both)
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(share)


def keyed(docs: DataFrame) -> DataFrame:
    """(key, text_hash, text): key, NO_ID for none, and text_hash tell
    documents apart."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("key"), F.xxhash64(text, F.col("doc_id").isNull()).alias("text_hash"), text.alias("text"))


def next_documents(rows: DataFrame) -> DataFrame:
    """(key, text_hash, n_chars, next_key, next_hash) by descending key."""
    ids = rows.groupBy("key", "text_hash").agg(F.max(F.length("text")).cast("long").alias("n_chars"))
    ids = written(ids, "ids")
    n = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-ids.count() // RANGE))
    dealt = written(ids.repartitionByRange(n, F.col("key").desc(), F.col("text_hash").desc()).withColumn("part", F.spark_partition_id()), "order")
    me = F.struct("key", "text_hash")
    # one row for each range
    firsts = dealt.groupBy("part").agg(F.max(me).alias("first"))
    after = Window.orderBy("part")
    firsts = firsts.select("part", F.coalesce(F.lead("first").over(after), F.first("first").over(after.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("then"))
    inside = F.lead(me).over(Window.partitionBy("part").orderBy(F.col("key").desc(), F.col("text_hash").desc()))
    found = dealt.withColumn("inside", inside).join(F.broadcast(firsts), "part").withColumn("next", F.coalesce("inside", "then"))
    return found.select("key", "text_hash", "n_chars", F.col("next.key").alias("next_key"), F.col("next.text_hash").alias("next_hash"))


def document_fingerprints(docs: DataFrame, sketch: int | None = SKETCH) -> DataFrame:
    """docs with anchors (array of struct(pos, hash)) and sketch, in place of
    columns of these names: the operator by itself."""
    own = [c for c in docs.columns if c not in ("anchors", "sketch")]
    out = with_anchors(docs.select(F.struct(*own).alias("row"), F.coalesce("text", F.lit("")).alias("t")), "t", "anchors")
    out = with_sketch(out, "t", "sketch", sketch)
    return out.select(*(F.col("row")[c].alias(c) for c in own), "anchors", "sketch")


def edited_likeness(docs: DataFrame, sketch: int | None = SKETCH) -> DataFrame:
    """Each document beside itself with its last third replaced by the next
    document's beginning, and beside the next document."""
    rows = keyed(docs)
    order = written(next_documents(rows), "next")
    asked = order.select(F.col("key").alias("by"), F.col("text_hash").alias("by_hash"), F.col("next_key").alias("key"), F.col("next_hash").alias("text_hash"), F.floor(F.col("n_chars") / 3).cast("int").alias("m"))
    # both joins read the same columns, so that one exchange of texts serves them
    own = with_sketch(rows, "text", "sketch", sketch)
    told = own.join(asked, ["key", "text_hash"]).select(F.col("by").alias("key"), F.col("by_hash").alias("text_hash"), "m", F.substring("text", F.lit(1), F.col("m")).alias("head"), F.col("sketch").alias("next_sketch"))
    # repeated rows of the next document give the same answer
    told = told.groupBy("key", "text_hash").agg(F.first(F.struct("m", "head", "next_sketch")).alias("next"))
    out = own.join(told, ["key", "text_hash"])
    n = F.length("text")
    out = out.select(F.nullif("key", F.lit(NO_ID)).alias("doc_id"), "text", "sketch", n.cast("long").alias("n_chars"), F.concat(F.substring("text", F.lit(1), n - F.col("next.m")), F.col("next.head")).alias("edited"), F.col("next.next_sketch").alias("next_sketch"))
    return with_sketch(out, "edited", "edited_sketch", sketch)


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = edited_likeness(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), fingerprint("sketch").alias("fingerprint"), fingerprint("edited_sketch").alias("edited_fingerprint"), likeness("sketch", "edited_sketch").alias("near_edited"), likeness("sketch", "next_sketch").alias("near_next"))
