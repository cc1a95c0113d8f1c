"""Language-model scores by stupid backoff, computed relationally.

Word unigrams and bigrams of the whole corpus are counted. A document's score is
the mean over its words of log S, where S(b after a) = c(ab) / c(a) if the
bigram table has ab, else ALPHA * c(b) / N; the first word has c(b) / N alone.
A bigram seen fewer than `least` (two) times is in no table: as the corpus is
scored by its own counts, a bigram seen once is known from the scored place
alone, and left in it would make rare wording look certain.

1. One pass counts words by block and gives each document's place; the blocks'
   counts are summed by hash into the unigram table. Words that are at least a
   FREQUENT-th of the corpus (so at most FREQUENT, whatever its size) go to all
   workers with their counts.
2. The hash space of bigrams is cut into `slices`, worked off one after another,
   so that the disk needed at once is a slice's. A slice's bigrams are counted
   within their document, exploded to rows and dealt and sorted by hash once:
   that one order is the count table's and the exploded rows', so a merge pass
   gives each row its count. What needs a frequent word's count is scored there.
3. A slice's rows that need another word's count are joined with the unigram
   table by the word; that word isn't frequent, so no key is hot. Rows of a bigram with over
   `large` rows aren't held: they leave the merge pass uncounted and are
   joined with their own partially aggregated count.

Sums are of whole numbers (10^-10), so that they don't depend on the order. Free
style: numpy over Arrow batches for words and the merge pass, DataFrame joins
and sums. Workers hold a slice of a batch and at most `large` rows of a bigram.

Defined results: words are parted at the contracts' white space, A-Z lower-cased;
a null or empty text, or one of white space, has no words and a null score;
repeated rows count in the tables as often as they are there, and each is
returned; a null id stays; an empty table gives no row; further columns are not
read.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SLICE_ROWS, forget, shuffles_dropped, table, written

ALPHA, LEAST, SLICES = 0.4, 2, 4
#: Words that may be sent to all workers: those of at least N / FREQUENT places,
#: so at most FREQUENT of them, 16 MB with their counts, whatever the corpus.
FREQUENT = 1 << 20
#: Rows of one bigram that the merge pass holds.
LARGE = 1 << 20
#: Words that a worker counts at a time.
WORDS_HELD = 1 << 21
#: Scored rows that are summed by document before they leave a worker.
SUMMED = 1 << 20
UNIT = 10**10
NO_ID = -(1 << 63)
TF_BITS, WORD_BITS = 20, 21
SEED = 42


def finished(h: np.ndarray) -> np.ndarray:
    """Spreads the bits of each 64-bit integer."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


def mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each pair of hashes."""
    with np.errstate(over="ignore"):
        return finished(a * np.uint64(0x9E3779B97F4A7C15) + b)


#: A 64-bit number for each byte, A-Z like a-z; 0 for white space.
BYTES = finished(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
BYTES[65:91] = BYTES[97:123]
BYTES[[32, *range(9, 14)]] = 0
ODD = 0xD1342543DE82EF95


def powers(base: int, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n, base, np.uint64))])


class WordHashes:
    """Hashes of the words of many texts at once: a polynomial in an odd number,
    by differences of one running sum over all bytes, then mixed with the
    word's length. Nothing is remembered but the powers."""

    def __init__(self):
        self.up = self.down = np.zeros(0, np.uint64)

    def __call__(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(hashes of all words, how many are each text's)."""
        data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
        n = len(data)
        if n > len(self.up):
            self.up, self.down = powers(ODD, 2 * n), powers(pow(ODD, -1, 1 << 64), 2 * n)
        values = BYTES[data]
        inside = np.concatenate([[False], values != 0])
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        starts, ends = edges[::2], edges[1::2]
        with np.errstate(over="ignore"):
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * self.up[:n])])
            h = (sums[ends] - sums[starts]) * self.down[starts] + (ends - starts).astype(np.uint64)
        text_ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
        return finished(h), np.diff(np.searchsorted(starts, text_ends), prepend=0)


def slices_of(batches):
    """(ids, texts as bytes) of SLICE_ROWS rows at a time."""
    for batch in batches:
        for start in range(0, batch.num_rows, SLICE_ROWS):
            part = batch.slice(start, SLICE_ROWS)
            yield part.column(0), [(t or "").encode("utf-8", "surrogatepass") for t in part.column(1).to_pylist()]


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def text_hashes(texts: list[bytes]) -> np.ndarray:
    """Tell texts of one id apart."""
    return np.array([xxhash.xxh32_intdigest(t, SEED) for t in texts], np.int64)


FIRST = ["w", "n", "doc_id", "text_hash", "n_words"]


def first_pass(docs: DataFrame) -> DataFrame:
    """FIRST: a row (w, n) for each word of a block; and a row for each document,
    w its first word (null if it has none), n null."""

    def run(batches):
        hashes, kept, held = WordHashes(), [], 0

        def counted():
            w, n = np.unique(np.concatenate(kept), return_counts=True)
            none = pa.nulls(len(w), pa.int64())
            return pa.RecordBatch.from_arrays([signed(w), pa.array(n), none, none, none], names=FIRST)

        for ids, texts in slices_of(batches):
            w, lens = hashes(texts)
            first = w[np.minimum(np.cumsum(lens) - lens, len(w) - 1)] if len(w) else np.zeros(len(lens), np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(first.view(np.int64), mask=lens == 0), pa.nulls(len(lens), pa.int64()), ids, pa.array(text_hashes(texts)), pa.array(lens)], names=FIRST)
            kept.append(w)
            held += len(w)
            if held >= WORDS_HELD:
                yield counted()
                kept, held = [], 0
        if held:
            yield counted()

    return docs.mapInArrow(run, ", ".join(f"{c} long" for c in FIRST))


class Places:
    """Places from 1 of hashes in a list, 0 for none: a table by the hash's
    leading bits, and a search among the few that share them."""

    BITS = 20

    def __init__(self, listed: np.ndarray):
        self.listed, shift = listed, np.uint64(64 - self.BITS)
        self.shift = shift
        self.slots = np.zeros(1 << self.BITS, np.int32)
        slot, first = np.unique(listed >> shift, return_index=True)
        self.slots[slot.astype(np.int64)] = first + 1
        rest = np.ones(len(listed), bool)
        rest[first] = False
        self.rest = np.flatnonzero(rest)
        self.ends = np.concatenate([np.zeros(1, np.uint64), listed])

    def __call__(self, h: np.ndarray) -> np.ndarray:
        place = self.slots[(h >> self.shift).astype(np.int64)].astype(np.int64)
        missed = np.flatnonzero((place > 0) & (self.ends[place] != h))
        place[missed] = 0
        if len(self.rest) and len(missed):
            own = self.listed[self.rest]
            at = np.minimum(np.searchsorted(own, h[missed]), len(own) - 1)
            hit = own[at] == h[missed]
            place[missed[hit]] = self.rest[at[hit]] + 1
        return place


ROW = ["h", "doc_id", "text_hash", "code", "a", "b"]


def bigrams(docs: DataFrame, k: int, slices: int, frequent: np.ndarray) -> DataFrame:
    """ROW: the bigrams of slice k, counted within their document. code holds the
    places of both words among `frequent` from 1, 0 for none, and the count; a
    and b are the hashes of words that aren't frequent, else 0."""
    most = (1 << TF_BITS) - 1

    def run(batches):
        hashes, places = WordHashes(), Places(frequent)
        for ids, texts in slices_of(batches):
            w, lens = hashes(texts)
            of = np.repeat(np.arange(len(lens)), lens)
            here = np.flatnonzero(of[:-1] == of[1:])
            h = mixed(w[here], w[here + 1])
            mine = h % np.uint64(slices) == np.uint64(k)
            here, h = here[mine], h[mine]
            if not len(h):
                continue
            order = np.argsort(h, kind="stable")
            sorted_h, doc = h[order], of[here[order]]
            new = np.flatnonzero((np.diff(sorted_h, prepend=~sorted_h[:1]) != 0) | (np.diff(doc, prepend=-1) != 0))
            tf = np.zeros(len(h), np.int64)
            tf[order[new]] = np.diff(new, append=len(h))
            once = np.flatnonzero(tf)  # in the documents' order again, whose columns then compress
            here, h, tf = here[once], h[once], tf[once]
            if tf.max() > most:  # a count that code can't hold is several rows
                times = -(-tf // most)
                part = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                here, h, tf = np.repeat(here, times), np.repeat(h, times), np.minimum(most, np.repeat(tf, times) - part * most)
            a, b = w[here], w[here + 1]
            ia, ib = places(a), places(b)
            code = ia << (TF_BITS + WORD_BITS) | ib << TF_BITS | tf
            a[ia > 0], b[ib > 0] = 0, 0
            doc = of[here]
            yield pa.RecordBatch.from_arrays([signed(h), ids.take(pa.array(doc)), pa.array(text_hashes(texts)[doc]), pa.array(code), signed(a), signed(b)], names=ROW)

    return docs.mapInArrow(run, ", ".join(f"{c} long" for c in ROW))


SCORED, BY_COUNT, BIG = 0, 1, 2
MET = "doc_id long, text_hash long, kind byte, key long, c long, tf long, s long"


def merge_pass(frequent: np.ndarray, counts: np.ndarray, total: int, alpha: float, least: int, large: int):
    """MET of rows sorted by h. Kind SCORED has s; BY_COUNT waits for the count
    of the word key (c: the bigram's, 0 if it isn't in the table); BIG has its
    bigram in key and the first word in c."""
    mask = (1 << WORD_BITS) - 1
    names = [f.split()[0] for f in MET.split(", ")]

    def pack(ids, text_hash, kind, key, c, tf, s):
        n = len(tf)
        return pa.RecordBatch.from_arrays([ids, pa.array(text_hash), pa.array(np.full(n, kind, np.int8) if np.isscalar(kind) else kind.astype(np.int8)), signed(key), signed(c), pa.array(tf), pa.array(s)], names=names)

    def parts(cols):
        h, ids, text_hash, code, a, b = cols
        return h, ids, text_hash, code & ((1 << TF_BITS) - 1), code >> (TF_BITS + WORD_BITS), (code >> TF_BITS) & mask, a, b

    def whole(cols):
        h, ids, text_hash, tf, ia, ib, a, b = parts(cols)
        at = np.flatnonzero(np.diff(h, prepend=~h[:1]))
        c = np.repeat(np.add.reduceat(tf, at), np.diff(at, append=len(h)))
        known = c >= least
        need = np.where(known, ia, ib)
        there = need > 0
        n = counts[np.maximum(need - 1, 0)] if len(counts) else np.ones(len(h), np.int64)
        s = np.rint(np.log(np.where(known, c / n, alpha * n / total)) * UNIT).astype(np.int64) * tf
        return pack(ids, text_hash, np.where(there, SCORED, BY_COUNT), np.where(there, 0, np.where(known, a, b)), np.where(there | ~known, 0, c), np.where(there, 0, tf), np.where(there, s, 0))

    def big(cols):
        h, ids, text_hash, tf, ia, _, a, _ = parts(cols)
        word = np.where(ia > 0, frequent.view(np.int64)[np.maximum(ia - 1, 0)], a) if len(frequent) else a
        return pack(ids, text_hash, BIG, h, word, tf, np.zeros(len(h), np.int64))

    def joined(pieces):
        return [pa.concat_arrays(x) if isinstance(x[0], pa.Array) else np.concatenate(x) for x in zip(*pieces)]

    def cut(cols, lo, hi):
        return [c.slice(lo, hi - lo) if isinstance(c, pa.Array) else c[lo:hi] for c in cols]

    def summed(pieces):
        """SCORED rows with one for each document of theirs."""
        ids, text_hash, s = (pa.concat_arrays(x) if isinstance(x[0], pa.Array) else np.concatenate(x) for x in zip(*pieces))
        own = ids.fill_null(NO_ID).to_numpy(zero_copy_only=False)
        order = np.argsort(mixed(own.view(np.uint64), text_hash.view(np.uint64)))
        at = np.flatnonzero((np.diff(own[order], prepend=~own[order[:1]]) != 0) | (np.diff(text_hash[order], prepend=-1) != 0))
        zero = np.zeros(len(at), np.int64)
        return pack(ids.take(pa.array(order[at])), text_hash[order[at]], SCORED, zero, zero, zero, np.add.reduceat(s[order], at))

    def run(batches):
        scored, n = [], 0
        for batch in merged(batches):
            there = pa.compute.equal(batch.column(2), SCORED)
            waits = batch.filter(pa.compute.invert(there))
            if waits.num_rows:
                yield waits
            done = batch.filter(there)
            scored.append((done.column(0), done.column(1).to_numpy(), done.column(6).to_numpy()))
            n += done.num_rows
            if n >= SUMMED:
                yield summed(scored)
                scored, n = [], 0
        if n:
            yield summed(scored)

    def merged(batches):
        kept, held, hot = [], 0, None  # rows of the last bigram so far; a bigram that is too large
        for batch in batches:
            cols = [batch.column(i) if i == 1 else batch.column(i).to_numpy(zero_copy_only=False) for i in range(len(ROW))]
            n = len(cols[0])
            if not n:
                continue
            begin = 0
            if hot is not None:
                begin = int(np.searchsorted(cols[0], hot, "right"))
                if begin:
                    yield big(cut(cols, 0, begin))
                if begin == n:
                    continue
                hot = None
            last = int(np.searchsorted(cols[0], cols[0][-1]))
            if last > begin or (kept and kept[-1][0][-1] != cols[0][-1]):
                done = [*kept, cut(cols, begin, max(begin, last))]
                done = joined([p for p in done if len(p[0])])
                yield whole(done)
                kept, held = [], 0
            last = max(begin, last)
            kept.append(cut(cols, last, n))
            held += n - last
            if held > large:
                hot = cols[0][-1]
                yield from (big(p) for p in kept)
                kept, held = [], 0
        if kept:
            yield whole(joined(kept))

    return run


def fixed(log) -> F.Column:
    return F.round(log * UNIT).cast("long")


def stupid_backoff(docs: DataFrame, alpha: float = ALPHA, least: int = LEAST, slices: int = SLICES, frequent: int = FREQUENT, large: int = LARGE) -> DataFrame:
    """(doc_id, n_words, score), a row for each of docs."""
    if least < 1 or not 0 < frequent < 1 << WORD_BITS or large < 1:
        raise ValueError(f"least and large are 1 or more, frequent is 1 to {(1 << WORD_BITS) - 1}")
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    with shuffles_dropped(spark):
        seen = written(first_pass(docs), "words")
        places = seen.where("n is null").select("doc_id", "text_hash", "n_words", "w")
        unigrams = written(seen.where("n is not null").groupBy("w").agg(F.sum("n").alias("cw")), "unigrams")
        total = unigrams.agg(F.sum("cw")).first()[0] or 1
        # at most `frequent` rows: their counts add up to no more than total
        often = unigrams.where(F.col("cw") * frequent >= total).toArrow()
        hashes, counts = often["w"].to_numpy().view(np.uint64), often["cw"].to_numpy()
        order = np.argsort(hashes)
        hashes, counts = hashes[order], counts[order]
        word = lambda c: unigrams.select(F.col("w").alias(c), "cw")
        doc = ["doc_id", "text_hash"]
        sums = []
        for k in range(slices):
            rows = bigrams(docs, k, slices, hashes).repartition(parts, "h").sortWithinPartitions("h")
            met = written(rows.mapInArrow(merge_pass(hashes, counts, total, alpha, least, large), MET), "met")
            waits = met.where(F.col("kind") == BY_COUNT).join(word("key"), "key")
            waits = waits.select(*doc, (F.col("tf") * fixed(F.when(F.col("c") > 0, F.log(F.col("c") / F.col("cw"))).otherwise(F.log(F.col("cw") * alpha / total)))).alias("s"))
            rows = met.where(F.col("kind") == BIG)
            counted = rows.groupBy("key").agg(F.sum("tf").alias("n"), F.first("c").alias("a")).join(word("a"), "a")
            # few bigrams are that large; Spark broadcasts them by their size, or splits the join's hot keys
            big = rows.join(counted.select("key", fixed(F.log(F.col("n") / F.col("cw"))).alias("each")), "key").select(*doc, (F.col("tf") * F.col("each")).alias("s"))
            done = met.where(F.col("kind") == SCORED).select(*doc, "s").unionByName(waits).unionByName(big)
            sums.append(written(done.groupBy(*doc).agg(F.sum("s").alias("s")), "sums"))
            forget(met)
        first = places.where("w is not null").join(word("w"), "w").select("doc_id", "text_hash", fixed(F.log(F.col("cw") / total)).alias("s"))
        parts_of = [x.select(*doc, "s", F.lit(0).cast("long").alias("copies"), F.lit(0).cast("long").alias("n_words")) for x in (*sums, first)]
        parts_of.append(places.select(*doc, F.lit(0).cast("long").alias("s"), F.lit(1).cast("long").alias("copies"), "n_words"))
        whole = reduce(DataFrame.unionByName, parts_of).groupBy(*doc).agg(*(F.sum(c).alias(c) for c in ("s", "copies", "n_words")))
        whole = written(whole, "scores")
        forget(seen, unigrams, *sums)
    # repeated rows have summed together
    score = F.when(F.col("n_words") > 0, F.col("s") / UNIT / F.col("n_words"))
    return whole.select("doc_id", (F.col("n_words") / F.col("copies")).cast("long").alias("n_words"), score.alias("score"), F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select("doc_id", "n_words", "score")


def op4_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = stupid_backoff(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", F.round("score", 6).alias("score"))


ORACLE_SQL = rf"""
WITH words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                   '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
  FROM documents),
placed AS (SELECT doc_id, unnest(w) AS b, unnest(list_concat([NULL], w[:-2])) AS a, unnest(range(len(w))) AS pos FROM words),
uni AS (SELECT b AS w, count(*) AS c FROM placed GROUP BY b),
bi AS (SELECT a, b, count(*) AS c FROM placed WHERE pos > 0 GROUP BY a, b HAVING count(*) >= {LEAST}),
n AS (SELECT count(b) AS total FROM placed),
scored AS (
  SELECT p.doc_id, round({UNIT} * ln(CASE WHEN pos = 0 THEN ub.c / total WHEN bi.c IS NOT NULL THEN bi.c / ua.c
                                     ELSE {ALPHA} * ub.c / total END))::BIGINT AS s
  FROM placed p CROSS JOIN n JOIN uni ub ON p.b = ub.w LEFT JOIN uni ua ON p.a = ua.w
       LEFT JOIN bi ON p.a = bi.a AND p.b = bi.b AND p.pos > 0)
SELECT w.doc_id, len(w.w) AS n_words, round(s.s::DOUBLE / {UNIT} / len(w.w), 6) AS score
FROM words w LEFT JOIN (SELECT doc_id, sum(s) AS s FROM scored GROUP BY doc_id) s ON w.doc_id = s.doc_id
"""
