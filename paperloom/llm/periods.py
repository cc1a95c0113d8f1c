"""Periodic runs of words, by comparing a text with itself at every lag.

A run is a stretch of words with smallest period q (words q apart are equal), at
least `least_words` long and at least `exponent` periods, that can't be extended.
At lag q the array of word ids is compared with itself shifted by q; a run is a
stretch of equal places that is q shorter than itself. Lags go up to n/exponent.
The comparisons of a block of lags are one matrix; lags with too few equal places
are done, the others' stretches are measured by their edges. A stretch that
repeats with a divisor of its lag has that smaller period and is no run of this
lag: with two periods or more no other smaller period is possible, so each lag is
judged by itself.

Texts of at most `whole_chars` code points are one task's row. Longer ones are
cut into ranges of lags of about `compares` comparisons each (`per_word` times the
text's words if that is more, so that what is sent stays small beside the work),
dealt by text and range, so that one text is many machines' work; their runs meet
again by text (a text of n words has fewer than n runs). Words are ids there.

Defined results: a null, empty or blank text has no words, no run, and an empty
text left; repeated rows and rows without an id are rows like any other; further
columns stay, but for those that have the name of an added one, which are
replaced.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WORD, free_name, map_rows, table, written

LEAST_WORDS, EXPONENT = 6, 4
WHOLE_CHARS, COMPARES, PER_WORD = 1 << 16, 1 << 25, 1 << 12
#: Cells of one matrix of comparisons, so that it stays in a core's cache.
CELLS = 1 << 18

Run = tuple[int, int, int]
RUNS = "array<struct<start:long,length:long,period:long>>"


def word_ids(words: list[str]) -> np.ndarray:
    known: dict[str, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.uint32, len(words))
    return ids.astype(np.uint16) if len(known) < 1 << 16 else ids


def prime_factors(n: int) -> Iterator[int]:
    p = 2
    while p * p <= n:
        if n % p == 0:
            yield p
            while n % p == 0:
                n //= p
        p += 1
    if n > 1:
        yield n


def stretches(equal: np.ndarray, least: int) -> Iterator[tuple[int, int]]:
    """(start, length) of the true stretches of that length or more."""
    edges = np.flatnonzero(np.diff(equal.view(np.int8), prepend=0, append=0))
    starts, ends = edges[::2], edges[1::2]
    for k in np.flatnonzero(ends - starts >= least):
        yield int(starts[k]), int(ends[k] - starts[k])


def runs_at(ids: np.ndarray, first: int, last: int, least_words: int = LEAST_WORDS, exponent: int = EXPONENT) -> list[Run]:
    """(start, length, period) of the runs with a period from first to last."""
    n, out = len(ids), []
    last = min(last, n // exponent)
    block = max(1, CELLS // max(1, n))
    for low in range(first, last + 1, block):
        lags = np.arange(low, min(low + block, last + 1))
        # row k is the text shifted by lags[k]; rows are cut to the longest
        width = n - low
        padded = np.concatenate([ids[low:], np.zeros(len(lags), ids.dtype)])
        shifted = np.lib.stride_tricks.as_strided(padded, (len(lags), width), (ids.itemsize, ids.itemsize))
        equal = shifted == ids[:width]
        least = np.maximum(least_words, exponent * lags) - lags
        for k in np.flatnonzero(np.count_nonzero(equal, axis=1) >= least):
            q = int(lags[k])
            for start, length in stretches(equal[k, : n - q], int(least[k])):
                text = ids[start : start + length + q]
                if not any(np.array_equal(text[q // p :], text[: -(q // p)]) for p in prime_factors(q)):
                    out.append((start, length + q, q))
    return out


def without_repeats(words: list[str], runs: list[Run]) -> str:
    """The words that are in no run, or in the first period of all that they are in."""
    if not runs:
        return " ".join(words)
    gone = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        gone[start + period] += 1
        gone[start + length] -= 1
    return " ".join([w for w, g in zip(words, np.cumsum(gone).tolist()) if not g])


def words_of(text: str | None) -> list[str]:
    return re.findall(WORD, text or "")


def whole(least_words: int, exponent: int) -> Callable[[], Callable]:
    """A text's runs and what is left of it."""

    def one(row):
        words = words_of(row["text"])
        runs = sorted(runs_at(word_ids(words), 1, len(words), least_words, exponent), key=lambda r: (r[0], r[2]))
        return row, runs, without_repeats(words, runs)

    return lambda: one


def range_ends(n: int, exponent: int, compares: int) -> list[int]:
    """Last lags of ranges that make about `compares` comparisons each."""
    last = n // exponent
    if not last:
        return []
    done = np.cumsum(n - np.arange(1, last + 1))
    ends = np.searchsorted(done, np.arange(compares, done[-1], compares)) + 1
    return sorted({*map(int, ends), last})


def ranges(exponent: int, compares: int, per_word: int) -> Callable[[], Callable]:
    """A long text as its word ids, and its ranges of lags."""

    def one(key, text):
        ids = word_ids(words_of(text))
        ends = range_ends(len(ids), exponent, max(compares, per_word * len(ids)))
        return key, ids.astype(np.uint32).tobytes(), [(low + 1, high) for low, high in zip([0, *ends], ends)]

    return lambda: one


def ranged(least_words: int, exponent: int) -> Callable[[], Callable]:
    """The runs of one range of lags."""

    def one(key, low, high, packed):
        return [(key, *run) for run in runs_at(np.frombuffer(packed, np.uint32), low, high, least_words, exponent)]

    one.many = True
    return lambda: one


def left_over() -> Callable:
    def one(row, runs):
        found = [(r["start"], r["length"], r["period"]) for r in runs]
        return row, found, without_repeats(words_of(row["text"]), found)

    return one


def periodic_runs(docs: DataFrame, least_words: int = LEAST_WORDS, exponent: int = EXPONENT, whole_chars: int = WHOLE_CHARS, compares: int = COMPARES, per_word: int = PER_WORD, names: tuple[str, str] = ("runs", "collapsed")) -> DataFrame:
    """docs with the columns `names` added: the runs of its words by start, then
    period, and the words left when each run keeps its first period, joined by
    one space."""
    own = [c for c in docs.columns if c not in names]
    runs, collapsed = names
    row = free_name(docs, "row")
    # exploded, as the test of the length would else take the text's own expressions along, over and over
    rows = docs.select(F.explode(F.array(F.struct(*docs.columns))).alias(row))
    shape = T.StructType([rows.schema[row], *T.StructType.fromDDL(f"`{runs}` {RUNS}, `{collapsed}` string").fields])
    text = F.col(row)["text"]
    long = F.coalesce(F.length(text) > whole_chars, F.lit(False))
    short = map_rows(rows.where(~long), [row], shape, whole(least_words, exponent))
    # a written row has one number, whichever task reads it again
    split = written(rows.where(long).select(F.monotonically_increasing_id().alias("k"), row), "long_texts")
    parts = map_rows(split.select("k", text.alias("text")), ["k", "text"], "k long, ids binary, lags array<struct<low:long,high:long>>", ranges(exponent, compares, per_word))
    parts = parts.select("k", "ids", F.explode("lags").alias("lags")).select("k", "lags.low", "lags.high", "ids").repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "k", "low")
    found = map_rows(parts, ["k", "low", "high", "ids"], "k long, start long, length long, period long", ranged(least_words, exponent))
    ordered = F.array_sort(F.collect_list(F.struct("start", "period", "length")))
    met = found.groupBy("k").agg(F.transform(ordered, lambda r: F.struct(r["start"], r["length"], r["period"])).cast(RUNS).alias(runs))
    met = written(split.join(met, "k", "left").withColumn(runs, F.coalesce(runs, F.array().cast(RUNS))), "long_runs")
    left = map_rows(met.select(row, runs), [row, runs], shape, left_over)
    return short.unionByName(left).select(*(F.col(row)[c].alias(c) for c in own), runs, collapsed)


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, text) as the query's contract has them: of documents with h%10 = 0
    each word i >= a is word a+(i-a)%p, where h is the id's CRC, g = h//10, a = g%n
    and p = 1+(n-a)//(3+g%8). Other texts, and those of rows without an id, stay."""
    h = F.crc32(F.col("doc_id").cast("string"))
    # null for texts that stay
    rows = docs.select("doc_id", "text", F.floor(h / 10).alias("g"), F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(f"({WORD})"), F.lit(1))).alias("words"))
    n = F.nullif(F.size("words"), F.lit(0))
    rows = rows.select("doc_id", "text", "words", "g", n.alias("n"), (F.col("g") % n).cast("int").alias("a"))
    tail = F.col("n") - F.col("a")
    rows = rows.withColumn("p", (1 + F.floor(tail / (3 + F.col("g") % 8))).cast("int"))
    cycle = F.flatten(F.array_repeat(F.slice("words", F.col("a") + 1, F.col("p")), F.ceil(tail / F.col("p")).cast("int")))
    edited = F.array_join(F.concat(F.slice("words", F.lit(1), F.col("a")), F.slice(cycle, F.lit(1), tail)), " ")
    return rows.select("doc_id", F.when(F.col("n").isNotNull(), edited).otherwise(F.col("text")).alias("text"))


def op13_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = periodic_runs(with_planted_runs(table(spark, sf_dir, "documents")))
    # greatest length, then least start, then least period
    first = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("s"), r["period"].alias("p"))))
    said = F.array_join(F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")
    out = out.select("doc_id", F.size("runs").cast("long").alias("n_runs"), first.alias("first"), F.sha2(said, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    length, period = -F.col("first.l"), F.col("first.p")
    return out.select("doc_id", "n_runs", F.col("first.s").alias("start"), length.alias("length"), period.alias("period"), F.floor(1000 * length / period).alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
