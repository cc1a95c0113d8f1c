"""SimHash near-duplicates by multi-index hashing.

A fingerprint is cut into two segments of 32 bits. Of two fingerprints that
differ in at most three bits, one segment differs in at most one. So the table
holds each segment under its exact value, and each fingerprint also probes the
values of the ball of radius one around each of its segments. Of the two that
differ in one bit of a segment, the one with the bit unset probes the other's
value, so only bits that are 0 are flipped: half the ball finds all matches.
Everything fetched is checked by its complete distance.

Equal fingerprints are one vertex. Rows of a segment value meet sorted in one
pass that keeps one value's rows at a time; its matches leave as a spanning
forest, never as all pairs. A value with over SPLIT rows (a large family of
near copies) is dealt out again, by the halves of the other segment under the
same argument, which bounds a value to 33 x 2^16 fingerprints and keeps all
links. Components are found over the forest (components.py).

Free style: fingerprints and the distance checks are numpy over Arrow batches.

Defined results: null and empty texts have no words and fingerprint zero, which
links like any other; repeated rows each keep their row; a null id keeps its
row, takes part in links, and never is a component's id unless all are null;
an empty table gives no row; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_rows, table, written
from .components import components

SEED, MOST_BITS = 42, 3
#: Rows of one segment value that are compared in one piece.
SPLIT = 1 << 14
LANES = np.uint64(0x0101010101010101)


def hashes(text: str | None, words: int = 3) -> np.ndarray:
    """XXH64 of each shingle, repeats included, as unsigned 64-bit integers."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z only, and the contract's white space
    if not w:
        return np.empty(0, np.uint64)
    shingles = map(b" ".join, zip(*(w[k:] for k in range(words)))) if len(w) >= words else [b" ".join(w)]
    return np.frombuffer(b"".join(map(xxhash.xxh64_digest, shingles, repeat(SEED))), ">u8").astype(np.uint64)


def fingerprint(h: np.ndarray) -> int:
    """Counts each bit over all h in byte lanes, 255 hashes at a time."""
    n = len(h)
    if not n:
        return 0
    rows = np.zeros(-(-n // 255) * 255, np.uint64)
    rows[:n] = h
    rows = rows.reshape(-1, 255)
    out = 0
    for j in range(8):
        lanes = ((rows >> np.uint64(j)) & LANES).sum(1, dtype=np.uint64).view(np.uint8).reshape(-1, 8).sum(0, dtype=np.int64)
        for k in range(8):
            out |= int(2 * int(lanes[k]) > n) << (8 * k + j)
    return out


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, fp); fp holds the 64 bits as a signed long."""

    def make():
        def each(doc_id, text):
            fp = fingerprint(hashes(text, words))
            return doc_id, fp - (1 << 64) if fp >> 63 else fp

        return each

    return map_rows(docs, ["doc_id", "text"], "doc_id long, fp long", make)


def forest(fps: np.ndarray) -> Iterator[tuple[int, int]]:
    """Edges that connect whatever links of at most MOST_BITS connect."""
    rest = np.unique(fps)
    while len(rest) > 1:
        todo, rest = [rest[0]], rest[1:]
        while todo and len(rest):
            x = todo.pop()
            near = np.bitwise_count(rest ^ x) <= MOST_BITS
            if near.any():
                found = rest[near]
                rest = rest[~near]
                todo.extend(found)
                for y in found:
                    yield x, y


def again(key: np.uint64, fps: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The rows of a large value, dealt by both halves of the other segment:
    keys, fingerprints, exact or probe."""
    other = np.where(key >> np.uint64(32), fps >> np.uint64(32), fps & np.uint64(0xFFFFFFFF))
    for half in range(2):
        value = (other >> np.uint64(16 * half)) & np.uint64(0xFFFF)
        base = (key << np.uint64(17)) | np.uint64(half << 16)
        yield base | value, fps, np.ones(len(fps), np.int8)
        for bit in range(16):
            flip = (value >> np.uint64(bit)) & np.uint64(1) == 0
            yield base | value[flip] | np.uint64(1 << bit), fps[flip], np.zeros(int(flip.sum()), np.int8)


def linker(split: int | None):
    """Links among the rows (key, fp, exact) of each key; sorted by key. Out:
    kind 2 is a link a, b; kinds 0 and 1 are rows of a large key, to be dealt
    again: a is the new key, b the fingerprint, kind whether exact."""

    def pack(a, b, kind):
        return pa.RecordBatch.from_arrays([pa.array(np.asarray(a, np.uint64).view(np.int64)), pa.array(np.asarray(b, np.uint64).view(np.int64)), pa.array(np.full(len(a), kind, np.int8) if np.isscalar(kind) else kind)], names=["a", "b", "kind"])

    def whole(keys, fps, exact):
        """All rows of some keys."""
        at = np.flatnonzero(np.diff(keys, prepend=~keys[:1]))
        n = np.diff(at, append=len(keys))
        use = (n > 1) & (np.maximum.reduceat(exact, at) > 0)
        two = at[use & (n == 2)]
        near = np.bitwise_count(fps[two] ^ fps[two + 1]) <= MOST_BITS
        near &= fps[two] != fps[two + 1]
        a, b = list(fps[two[near]]), list(fps[two[near] + 1])
        for i, k in zip(at[use & (n > 2)], n[use & (n > 2)]):
            for x, y in forest(fps[i : i + k]):
                a.append(x)
                b.append(y)
        if a:
            yield pack(a, b, 2)

    def run(batches):
        kept: list[tuple] = []  # rows of the last key so far
        held, large = 0, None
        for batch in batches:
            keys, fps, exact = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            keys, fps = keys.view(np.uint64), fps.view(np.uint64)
            if not len(keys):
                continue
            if large is not None:
                end = int(np.searchsorted(keys, large, "right"))
                for piece in again(large, fps[:end]) if end else ():
                    yield pack(*piece)
                keys, fps, exact = keys[end:], fps[end:], exact[end:]
                if not len(keys):
                    continue
                large = None
            first = int(np.searchsorted(keys, keys[-1]))
            if first or (kept and kept[-1][0][-1] != keys[-1]):
                done = [*kept, (keys[:first], fps[:first], exact[:first])]
                done = [np.concatenate(x) for x in zip(*done)]
                if len(done[0]):
                    yield from whole(*done)
                kept, held = [], 0
            kept.append((keys[first:], fps[first:], exact[first:]))
            held += len(keys) - first
            if split and held > split:
                large = keys[-1]
                for piece in again(large, np.concatenate([x[1] for x in kept])):
                    yield pack(*piece)
                kept, held = [], 0
        if kept:
            yield from whole(*(np.concatenate(x) for x in zip(*kept)))

    return run


def index(fps: DataFrame) -> DataFrame:
    """(key, fp, exact): each fp under its two segments, and its probes. The
    segment's number is bit 32 of key."""
    rows = []
    for seg, value in ((0, F.shiftrightunsigned("fp", 32)), (1, F.col("fp").bitwiseAND(0xFFFFFFFF))):
        key = value + (seg << 32)
        rows.append(F.array(F.struct(key.alias("key"), F.lit(1).cast("byte").alias("exact"))))
        rows.append(F.filter(F.array(*(F.struct((key + (1 << i)).alias("key"), (value.bitwiseAND(1 << i) != 0).cast("byte").alias("exact")) for i in range(32))), lambda x: x["exact"] == 0))
    return fps.select("fp", F.explode(F.concat(*rows)).alias("x")).select("x.key", "fp", "x.exact")


def links(fps: DataFrame, split: int = SPLIT) -> DataFrame:
    """(a, b) over distinct fingerprints: a forest that has the components of
    all links of at most MOST_BITS differing bits."""
    schema = "a long, b long, kind byte"
    out = written(index(fps).repartition("key").sortWithinPartitions("key").mapInArrow(linker(split), schema), "links")
    deep = out.where("kind < 2").select(F.col("a").alias("key"), F.col("b").alias("fp"), F.col("kind").alias("exact"))
    deep = deep.repartition("key").sortWithinPartitions("key").mapInArrow(linker(None), schema)
    return out.where("kind = 2").unionByName(deep).select("a", "b")


def simhash_components(docs: DataFrame, words: int = 3, split: int = SPLIT) -> DataFrame:
    """(doc_id, fp, component_id), a row for each of docs."""
    rows = written(fingerprints(docs, words), "fingerprints")
    distinct = written(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = components(links(distinct.select("fp"), split)).select(F.col("vertex").alias("fp"), "root")
    rooted = written(distinct.join(roots, "fp"), "rooted")
    ids = written(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "ids")
    linked = rooted.join(ids, "root").select("fp", "component_id")
    alone = distinct.join(roots, "fp", "left_anti").select("fp", F.col("least").alias("component_id"))
    return rows.join(written(linked.unionByName(alone), "components"), "fp").select("doc_id", "fp", "component_id")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash_components(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
