"""Words one edit apart, by merging the light subtrees of their trie.

The trie of all words is a table of its edges (node, character, words below). At
each node the edge with most words below is heavy, all others are light, and so is
a word's end. A word meets few light edges on its way (at most log2 of the number
of words, and its end). At a light edge with character c of a node p, for a word
p c s, the light subtree is merged into what is there, with one character skipped
or replaced, as keys that a word can end at:

* replaced by the heavy character h: p h s, a word in the heavy subtree
* skipped: p s, any word
* before it the heavy character: p h c s, a word in the heavy subtree
* replaced by a mark: p * s, where other light subtrees of p end too

Terminals that coincide are pairs one edit apart. Every pair is met: two words
part at a node where at most one goes on by the heavy edge. Those that differ by a
replaced character meet at p h s, or at p * s if both edges are light; of those
that differ by a skipped one, the skipped character being the last of its like,
the longer's edge is light (p s), or the shorter's is and the longer's is heavy
(p h c s). As the smaller side is merged into the greater, a word is copied to few
keys, not to one for each of its characters.

Nodes and keys are polynomial hashes, worked out from a word's prefix hashes; pairs
are compared exactly before they count. Equal hashes of different nodes only make
more edges light, equal hashes of different keys only more pairs to compare.

Scale: the trie is rows, dealt by node and edge; light edges with at least a
4,096th of the words below (at most 4,096*log2(words) of them) are broadcast, so
that no node's words meet in one task, and the others are joined. No list holds
more than a word's light edges or an alphabet's characters.

Defined results: null texts and ids, empty texts and tables give what they hold
(no word; a null id deletes no character); repeated rows count again; further
columns are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, forget, map_rows, table, written

LETTERS = r"A-Za-zÀ-ÿ"
LEAST_CHARS, LEAST_COUNT, RATIO, DELETED = 7, 2, 10, 31
#: Light edges with this share of the words below them are broadcast.
WIDE = 4096

PRIME, BASE = (1 << 61) - 1, 0x1F3D5B79A2C4E687 % ((1 << 61) - 1)
#: Edges that no character has: a word's end, the mark of a replaced one.
END, MARK = -1, 0x110000


def prefix_hashes(word: str, prime: int = PRIME) -> list[int]:
    out, h = [0], 0
    for c in word:
        h = (h * BASE + ord(c) + 2) % prime
        out.append(h)
    return out


def edges(prime: int) -> Callable[[], Callable]:
    """(id, place, node, edge): a word's way through the trie."""

    def one(key, word):
        codes = [*map(ord, word), END]
        return [(key, k, h, c) for k, (h, c) in enumerate(zip(prefix_hashes(word, prime), codes))]

    one.many = True
    return lambda: one


def merged(prime: int) -> Callable[[], Callable]:
    """(marked, key, word): where the copies of a word end, by its light edges
    (place, heavy character). Keys p * s are marked."""

    def one(word, lights):
        at = prefix_hashes(word, prime)
        n, whole, out = len(word), at[-1], set()
        for place, heavy in ((x["place"], x["heavy"]) for x in lights):
            if place > n:
                continue  # of another word with the same id
            node, high = at[place], pow(BASE, n - place, prime)
            rest = whole - node * high  # of word[place:]
            out.add((False, ((node * BASE + heavy + 2) * high + rest) % prime))  # p h c s
            if place < n:
                low = pow(BASE, n - place - 1, prime)
                tail = whole - at[place + 1] * low  # of word[place + 1:]
                out.add((False, (node * low + tail) % prime))  # p s
                for c in (heavy, MARK):  # p h s, p * s
                    out.add((c == MARK, ((node * BASE + c + 2) * low + tail) % prime))
        return [(marked, key, word) for marked, key in out]

    one.many = True
    return lambda: one


def whole_key(prime: int) -> Callable[[], Callable]:
    return lambda: lambda word: (prefix_hashes(word, prime)[-1], word)


def ways_of(words: DataFrame, prime: int) -> DataFrame:
    return map_rows(words, ["id", "word"], "id long, place int, node long, edge int", edges(prime))


def light_edges(words: DataFrame, prime: int = PRIME) -> DataFrame:
    """(node, edge, heavy, below): the edges that aren't their node's heavy one.
    words: (id, word)."""
    below = ways_of(words, prime).groupBy("node", "edge").agg(F.count("*").alias("below"))
    below = written(below, "trie")
    # the most words below, then the least character; an end is never heavy
    best = F.max(F.when(F.col("edge") != END, F.struct("below", (-F.col("edge")).alias("least"))))
    heavy = below.groupBy("node").agg(best.alias("best"), F.count("*").alias("edges")).where("edges > 1").select("node", (-F.col("best.least")).alias("heavy"))
    out = written(below.join(heavy, "node").where("edge <> heavy").select("node", "edge", "heavy", "below"), "light")
    forget(below)
    return out


def one_edit_pairs(words: DataFrame, wide: int = WIDE, prime: int = PRIME) -> DataFrame:
    """(word, near): both ways, each pair once, of different words one edit apart."""
    named = words.select(F.xxhash64("word").alias("id"), "word")
    light, ways = light_edges(named, prime), ways_of(named, prime)
    least = F.lit(max(1, named.count() // wide))
    on = ["node", "edge"]
    many = ways.join(F.broadcast(light.where(F.col("below") >= least).drop("below")), on)
    rest = ways.join(light.where(F.col("below") < least).drop("below").hint("shuffle_hash"), on)
    lights = many.unionByName(rest).groupBy("id").agg(F.collect_list(F.struct("place", "heavy")).alias("lights"))
    copies = written(map_rows(named.join(lights, "id"), ["word", "lights"], "marked boolean, key long, word string", merged(prime)), "copies")
    ends = map_rows(named, ["word"], "key long, near string", whole_key(prime))
    found = copies.where("not marked").select("key", "word").join(ends, "key").select("word", "near")
    # words that end at one key with a mark differ there only: no more than an alphabet has
    met = copies.where("marked").groupBy("key").agg(F.collect_set("word").alias("all")).where("size(all) > 1")
    met = met.select("all", F.explode("all").alias("word")).select("word", F.explode("all").alias("near"))
    pairs = found.unionByName(found.select(F.col("near").alias("word"), F.col("word").alias("near"))).unionByName(met)
    return pairs.where((F.col("word") != F.col("near")) & (F.levenshtein("word", "near", 1) == 1)).distinct()


def spelling_variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """words (word, n), each once, with form (the near word of greatest n, then
    least, if it has `ratio` times the word's n or more), root (the last form of
    forms), n_near and form_n."""
    words = written(words.select("word", F.col("n").cast("long").alias("n")), "words")
    pairs = one_edit_pairs(words)
    counted = pairs.join(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
    best = counted.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("least"), "near")).alias("best"))
    rows = words.join(best, "word", "left")
    top = -F.col("best.least")
    rows = rows.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(top >= ratio * F.col("n"), F.struct(F.col("best.near").alias("form"), top.alias("form_n"))).alias("f"))
    rows = written(rows.select("word", "n", "n_near", "f.form", "f.form_n"), "forms")
    # forms grow by the ratio, so ways are short; each round doubles what a word has followed
    most = rows.agg(F.max("n")).first()[0] or 1
    roots = rows.where("form is not null").select("word", F.col("form").alias("root"))
    for _ in range(math.ceil(math.log2(max(2.0, math.log(most, max(ratio, 2)) + 1)))):
        on = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        roots = written(roots.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "roots")
    return rows.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def counted_words(docs: DataFrame, least_chars: int = LEAST_CHARS, least_count: int = LEAST_COUNT, deleted: int | None = DELETED) -> DataFrame:
    """(word, n): the runs of letters of all texts, A-Z lower-cased. Where
    `deleted` divides h, the CRC of `<doc_id>:<run>`, the run loses its code point
    h % length."""
    # longer runs only: a shorter one gives no word, and is no part of a longer
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(f"[{LETTERS}]{{{least_chars},}}"), F.lit(0))).alias("run"))
    word: Column = ascii_lower(F.col("run"))
    rows = runs.select(word.alias("word"), F.crc32(F.concat(F.col("doc_id").cast("string"), F.lit(":"), word)).alias("h"))
    if deleted:
        at = (F.col("h") % F.length("word")).cast("int")
        cut = F.concat(F.substring("word", F.lit(1), at), F.substring("word", at + 2, F.length("word")))
        rows = rows.select(F.when(F.col("h") % deleted == 0, cut).otherwise(F.col("word")).alias("word")).where(F.length("word") >= least_chars)
    return rows.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def op11_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(counted_words(table(spark, sf_dir, "documents")))
