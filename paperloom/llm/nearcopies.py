"""Near copies by the exact likeness of their sets of five-word shingles.

Two texts are linked if |A & B| / |A | B| is LEAST (4/5) or more and, with
`fingerprinted`, if their SimHash fingerprints are at most three bits apart: these
come first, through simhash's index, and what they connect is one component for all
that follows. SimHash alone can't decide the likeness: at 0.8 two fingerprints are expected to differ in ten of 64
bits, and no radius that an index can probe finds all. So texts meet by prefix
filtering, which misses none: in the order of the shingles' hashes, two sets
that are alike enough share one of the first n - ceil(4n/5) + 1 of each.

1. Equal sets are one vertex. Sets that share a prefix hash are held against the
   least of them; what that links is one component and is compared no more.
2. Where a prefix hash still has sets of different components, its rows meet in
   one task (in tiles of at most 2 x TILE rows, however many share the hash).
   Whether a pair could be alike is bounded there, without error, by the sizes,
   by what can follow that hash, and by 256-bit maps of both sets. A spanning
   forest of the pairs that could be leaves each tile; its components are groups.
3. Both sets of a link are in one group, so each whole set is dealt once, to its
   group, and compared exactly with the others there. A group of more than
   MEMBERS sets or MEMBER_HASHES hashes doesn't fit a task: its rows that have a
   partner go through step 2 once more, with maps as wide as the sets are large
   (which long texts need), and that parts it. A group that is still too large
   meets by prefix hash, in tiles as in 2, with prefixes (a pair is compared under
   the first hash that both have) and then whole sets, for a slice of the hashes at a time.

So no table holds pairs of a group: each has at most a row for a set and prefix
hash, and the rows of step 1. The whole sets are dealt once, into a bucketed,
sorted table: what later needs some of them joins it without dealing it again.

Defined results: texts of fewer than five words are one shingle; null and empty
texts have the empty set, which is like itself only; a null id takes part, and
never is a component's id unless all are null; an empty table gives no row;
further columns are not read.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SLICE_ROWS, forget, scratch_root, shuffles_dropped, written
from .components import components
from .lines import BUCKETS
from .simhash import fingerprint, hashes
from .simhash import links as fingerprint_links

WORDS, LEAST = 5, (4, 5)
#: Rows of one prefix hash in a block; two blocks meet in a task.
TILE = 4096
#: Sets of a group, and hashes of them all, that one task compares.
MEMBERS, MEMBER_HASHES = 4096, 1 << 21
#: Bits of the widest map.
WIDEST = 1 << 14
#: Slices of the tokens whose whole sets are dealt one after another.
SLICES = 8


def prefix(n: int) -> int:
    """Hashes of a set of n of which a set that is alike enough shares one."""
    return n + (LEAST[0] * n // -LEAST[1]) + 1 if n else 0


def shingle_sets(docs: DataFrame, fingerprinted: bool = False) -> DataFrame:
    """(doc_id, text_hash, sid, n, hashes) and, if asked for, the text's SimHash fp:
    hashes, sorted, only in a set's first row of a task, so that a set with very
    many copies stays small."""

    def run(batches):
        seen = set()
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(start, SLICE_ROWS)
                sids, sizes, sets, fps = [], [], [], []
                for text in part.column(1).to_pylist():
                    data = np.unique(hashes(text, WORDS)).astype("<u8").tobytes()
                    sid = int.from_bytes(xxhash.xxh64_digest(data), "big", signed=True)
                    sids.append(sid)
                    sizes.append(len(data) // 8)
                    sets.append(None if sid in seen else data)
                    seen.add(sid)
                    if fingerprinted:
                        fps.append(fingerprint(hashes(text)))
                columns = [part.column(0), part.column(2), pa.array(sids, pa.int64()), pa.array(sizes, pa.int32()), pa.array(sets, pa.binary())]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(np.array(fps, np.uint64).view(np.int64))][: len(names)], names=names)

    schema = "doc_id long, text_hash long, sid long, n int, hashes binary" + ", fp long" * fingerprinted
    names = [c.split()[0] for c in schema.split(", ")]
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash")).mapInArrow(run, schema)


@contextmanager
def buckets_kept(spark: SparkSession) -> Iterator[None]:
    """Inside, scans of bucketed tables stay by bucket and in order."""
    before = {key: spark.conf.get(key) for key in BUCKETS}
    for key, value in BUCKETS.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def stored_rows(rows: DataFrame) -> DataFrame:
    """rows of shingle_sets() + (place), bucketed and sorted by place: the sid of
    a row that holds its set, else a hash of the row, which spreads the rows of
    a set with very many copies."""
    spark, name = rows.sparkSession, f"rows_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    spread = F.xxhash64("doc_id", "text_hash", F.monotonically_increasing_id())
    placed = rows.withColumn("place", F.when(F.col("hashes").isNotNull(), F.col("sid")).otherwise(spread)).repartition(buckets, "place")
    placed.write.bucketBy(buckets, "place").sortBy("place").option("path", f"{scratch_root(spark)}/{name}").saveAsTable(name)
    out = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the name only: the files are the scratch folder's
    return out


def sets_of(rows: DataFrame) -> DataFrame:
    """(sid, n, hashes) of stored_rows(), bucketed by sid; a set is there once for
    each task that met it."""
    return rows.where("hashes is not null").select(F.col("place").alias("sid"), "n", "hashes")


def prefixes(sets: DataFrame) -> DataFrame:
    """(token, sid, n, rest) of each prefix hash; rest: hashes of the set from it on."""

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE_ROWS):
                sids, sizes, data = (c.to_pylist() for c in batch.slice(start, SLICE_ROWS).columns)
                most = [prefix(n) for n in sizes]
                tokens = b"".join(x[: 8 * p] for x, p in zip(data, most))
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(tokens, "<i8")), pa.array(np.repeat(np.array(sids, np.int64), most)), pa.array(np.repeat(np.array(sizes, np.int32), most)), pa.array(np.concatenate([np.arange(n, n - p, -1, np.int32) for n, p in zip(sizes, most)]))], names=["token", "sid", "n", "rest"])

    return sets.select("sid", "n", "hashes").mapInArrow(run, "token long, sid long, n int, rest int")


def shared(rows: DataFrame) -> DataFrame:
    """(token, sid, n, rest, first, first_n): tokens of two sets or more, and their
    least set. Streams: of a token only its least set is held."""
    names = ["token", "sid", "n", "rest", "first", "first_n"]

    def run(batches):
        held = None  # token, least sid, its n and rest, last sid, whether told
        for batch in batches:
            token, sid, n, rest = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            if held and not held[5]:
                token, sid, n, rest = (np.concatenate([np.array([x], c.dtype), c]) for x, c in zip(held[:4], (token, sid, n, rest)))
            new = (np.diff(token, prepend=~token[:1]) != 0) | (np.diff(sid, prepend=~sid[:1]) != 0)
            if held and held[5] and len(token):
                new[0] = (token[0], sid[0]) != (held[0], held[4])
            token, sid, n, rest = token[new], sid[new], n[new], rest[new]
            if not len(token):
                continue
            at = np.flatnonzero(np.diff(token, prepend=~token[:1]))
            first, first_n, first_rest, size = sid[at], n[at], rest[at], np.diff(at, append=len(token))
            told = size > 1
            if held and held[5] and token[0] == held[0]:
                first[0], first_n[0], first_rest[0], told[0] = held[1], held[2], held[3], True
            held = (token[-1], first[-1], first_n[-1], first_rest[-1], sid[-1], bool(told[-1]))
            many = np.repeat(told, size)
            if many.any():
                yield pa.RecordBatch.from_arrays([pa.array(c[many]) for c in (token, sid, n, rest, np.repeat(first, size), np.repeat(first_n, size))], names=names)

    return rows.repartition("token").sortWithinPartitions("token", "sid").mapInArrow(run, "token long, sid long, n int, rest int, first long, first_n int")


TILED = "token long, low int, high int, block int, sid long, n int, root long, rest int"


def tiled(rows: DataFrame, tile: int) -> DataFrame:
    """TILED: the rows (token, sid, n, rest, root) of tokens with more than one
    root, each once for every pair of blocks that its own is in. Two sets that
    are too short from the token on for a link aren't looked at again."""
    mixed = rows.groupBy("token").agg(F.count("*").alias("rows"), F.min("root").alias("a"), F.max("root").alias("b"), F.min("rest").alias("least"), F.sum("n").alias("sizes"))
    mixed = mixed.where("a < b").where((F.col("rows") > 2) | (F.col("least") * sum(LEAST) >= F.col("sizes") * LEAST[0])).select("token", F.ceil(F.col("rows") / tile).cast("int").alias("blocks"))
    rows = rows.join(mixed, "token").withColumn("block", F.pmod(F.xxhash64("sid"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return rows.select("token", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "sid", "n", "root", "rest")


def maps_and_prefixes(sets: DataFrame) -> DataFrame:
    """(sid, map, prefix): which low bytes a set's hashes have, and its prefix."""

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE_ROWS):
                sids, sizes, data = batch.slice(start, SLICE_ROWS).columns
                data = data.to_pylist()
                yield pa.RecordBatch.from_arrays([sids, pa.array([byte_map(np.frombuffer(x, "<u8")).tobytes() for x in data]), pa.array([x[: 8 * prefix(n)] for x, n in zip(data, sizes.to_pylist())])], names=["sid", "map", "prefix"])

    return sets.select("sid", "n", "hashes").mapInArrow(run, "sid long, map binary, prefix binary")


def byte_map(hashes: np.ndarray) -> np.ndarray:
    bits = np.zeros(256, np.uint8)
    bits[(hashes & np.uint64(255)).astype(np.int64)] = 1
    return np.packbits(bits).view(np.uint64)


#: Up to so many rows of a tile are compared one by one.
FEW = 12


def earlier(n: np.ndarray, rest: np.ndarray, prefixes: list[np.ndarray]) -> np.ndarray:
    """For each row, bits of the hashes before the token that other rows have, too."""
    at = n - rest
    early = np.concatenate([p[:k] for p, k in zip(prefixes, at)])
    owner = np.repeat(np.arange(len(n)), at)
    _, number, count = np.unique(early, return_inverse=True, return_counts=True)
    twice = count > 1
    column, use = np.cumsum(twice) - 1, twice[number]
    met = np.zeros((len(n), -(-max(1, int(twice.sum())) // 64) * 64), bool)
    met[owner[use], column[number[use]]] = True
    return np.packbits(met, axis=1).view(np.uint64)


def partners(n: np.ndarray, rest: np.ndarray, root: np.ndarray, block: np.ndarray, maps: list[int], prefixes: list[np.ndarray] | None) -> Iterator[tuple[int, np.ndarray]]:
    """(i, all j > i) of a tile's rows that have different roots and may be alike,
    if the tile's hash is the first that they share; given prefixes, only those
    of which it is. In a tile of two blocks, i and j are of both."""
    if len(n) <= FEW:
        yield from few_partners(n.tolist(), rest.tolist(), root.tolist(), block.tolist(), maps, prefixes)
        return
    met = earlier(n, rest, prefixes) if prefixes is not None else np.zeros((len(n), 1), np.uint64)
    bits = np.frombuffer(b"".join(m.to_bytes(32, "little") for m in maps), np.uint64).reshape(-1, 4)
    cross = len(np.unique(block)) > 1
    for i in range(len(n) - 1):
        need = LEAST[0] * (n[i] + n)
        ok = (root[i + 1 :] != root[i]) & (sum(LEAST) * np.minimum(rest[i], rest[i + 1 :]) >= need[i + 1 :])
        if cross:
            ok &= block[i + 1 :] != block[i]
        j = np.flatnonzero(ok) + i + 1
        if len(j):
            j = j[~(met[j] & met[i]).any(1)]
            most = np.minimum(n[i] - np.bitwise_count(bits[i] & ~bits[j]).sum(1, dtype=np.int64), n[j] - np.bitwise_count(bits[j] & ~bits[i]).sum(1, dtype=np.int64))
            j = j[sum(LEAST) * most >= need[j]]
            if len(j):
                yield i, j


def few_partners(n: list[int], rest: list[int], root: list[int], block: list[int], maps: list[int], prefixes: list[np.ndarray] | None) -> Iterator[tuple[int, list[int]]]:
    """What partners() says, a pair at a time."""
    cross = len(set(block)) > 1
    for i in range(len(n) - 1):
        found = []
        for j in range(i + 1, len(n)):
            if root[i] == root[j] or (cross and block[i] == block[j]):
                continue
            need = LEAST[0] * (n[i] + n[j])
            if sum(LEAST) * min(rest[i], rest[j]) < need or sum(LEAST) * min(n[i] - (maps[i] & ~maps[j]).bit_count(), n[j] - (maps[j] & ~maps[i]).bit_count()) < need:
                continue
            a, b = n[i] - rest[i], n[j] - rest[j]
            if prefixes is None or not (a and b and common(prefixes[i][:a], prefixes[j][:b])):
                found.append(j)
        if found:
            yield i, found


def whole_tiles(batches: Iterator[pa.RecordBatch], keys: int = 3) -> Iterator[tuple[pa.RecordBatch, list[tuple[int, int]]]]:
    """Batches of whole tiles and where each tile of two rows or more is, of
    batches sorted by tile: by the first `keys` columns."""
    kept: list[pa.RecordBatch] = []  # rows of the last tile so far

    def key(batch, i):
        return tuple(batch.column(c)[i].as_py() for c in range(keys))

    def told(rows, starts):
        return rows, [(s, e) for s, e in zip(starts, [*starts[1:], rows.num_rows]) if e - s > 1]

    for batch in batches:
        if not batch.num_rows:
            continue
        if kept and key(kept[0], 0) == key(batch, batch.num_rows - 1):
            kept.append(batch)
            continue
        rows = pa.concat_batches([*kept, batch])
        starts = np.flatnonzero(np.any([np.diff(x, prepend=~x[:1]) != 0 for x in (rows.column(c).to_numpy(zero_copy_only=False) for c in range(keys))], axis=0)).tolist()
        if len(starts) > 1:
            yield told(rows.slice(0, starts[-1]), starts[:-1])
        kept = [rows.slice(starts[-1])]
    if kept:
        yield told(pa.concat_batches(kept), [0])


def columns(rows: pa.RecordBatch) -> list:
    """block, sid, n, root, rest."""
    block, sid, n, root, rest = (rows.column(c).to_numpy(zero_copy_only=False) for c in range(3, 8))
    return [block, sid, n.astype(np.int64), root, rest.astype(np.int64)]


def in_tiles(rows: DataFrame) -> DataFrame:
    return rows.repartition("token", "low", "high").sortWithinPartitions("token", "low", "high")


def joining(size: int, found: Iterator[tuple[int, np.ndarray]], test: Callable[[int, int], bool] | None = None) -> Iterator[tuple[int, int]]:
    """Of found (i, all its j) those pairs that pass the test, if there is one,
    and join two components of size rows."""
    label, left = np.arange(size), size
    for i, partner in found:
        j = np.asarray(partner)
        j = j[label[j] != label[i]]
        if test:
            for k in j.tolist():
                if label[k] != label[i] and test(i, k):
                    yield i, k
                    label[label == label[k]] = label[i]
                    left -= 1
        elif len(j):
            old, at = np.unique(label[j], return_index=True)
            yield from ((i, int(k)) for k in j[at])
            label[np.isin(label, old)] = label[i]
            left -= len(old)
        if left == 1:
            return


def wide_map(hashes: np.ndarray) -> bytes:
    """Which low bits a set's hashes have: a bit or two for each of the set, 256
    at least and WIDEST at most."""
    size = min(WIDEST, max(256, 1 << (len(hashes) - 1).bit_length()))
    bits = np.zeros(size, np.uint8)
    bits[(hashes & np.uint64(size - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def wide_maps(sets: DataFrame) -> DataFrame:
    """(sid, wide)."""

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE_ROWS):
                sids, data = batch.slice(start, SLICE_ROWS).columns
                yield pa.RecordBatch.from_arrays([sids, pa.array([wide_map(np.frombuffer(x, "<u8")) for x in data.to_pylist()], pa.binary())], names=["sid", "wide"])

    return sets.select("sid", "hashes").mapInArrow(run, "sid long, wide binary")


def by_wide_maps(n: list[int], wide: list[bytes]) -> Callable[[int, int], bool]:
    """Whether rows i and j may be alike, by their wide maps; the wider one is
    folded to the other's width."""
    maps = [int.from_bytes(x, "little") for x in wide]

    def fold(x: int, size: int, width: int) -> int:
        while size > width:
            size //= 2
            x = x & ((1 << size) - 1) | x >> size
        return x

    def test(i: int, j: int) -> bool:
        a, b = 8 * len(wide[i]), 8 * len(wide[j])
        x, y = fold(maps[i], a, b), fold(maps[j], b, a)
        return sum(LEAST) * min(n[i] - (x & ~y).bit_count(), n[j] - (y & ~x).bit_count()) >= LEAST[0] * (n[i] + n[j])

    return test


def candidates(rows: DataFrame) -> DataFrame:
    """(a, b) over rows of TILED + (map) or (map, wide): a spanning forest of the
    pairs of each tile that may be alike."""

    def run(batches):
        for rows, places in whole_tiles(batches):
            block, sid, n, root, rest = columns(rows)
            maps = [int.from_bytes(x, "little") for x in rows.column(8).to_pylist()]
            wide = rows.column(9).to_pylist() if rows.num_columns > 9 else None
            found = []
            for s, e in places:
                test = by_wide_maps(n[s:e].tolist(), wide[s:e]) if wide else None
                found += [(s + i, s + j) for i, j in joining(e - s, partners(n[s:e], rest[s:e], root[s:e], block[s:e], maps[s:e], None), test)]
            if found:
                a, b = np.array(found).T
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(sid[a], sid[b])), pa.array(np.maximum(sid[a], sid[b]))], names=["a", "b"])

    return in_tiles(rows).mapInArrow(run, "a long, b long")


def alike_in(n: np.ndarray, root: np.ndarray, sets: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray]]:
    """(i, all j > i) of sets ordered by size that are alike enough and have
    different roots. What i shares with all that aren't too long is counted at
    once."""
    _, ids = np.unique(np.concatenate(sets), return_inverse=True)
    starts = np.cumsum(n) - n
    mark = np.zeros(len(ids), np.int32)
    for i in range(len(n) - 1):
        end = int(np.searchsorted(n, n[i] * LEAST[1] // LEAST[0], "right"))
        if end <= i + 1 or (root[i + 1 : end] == root[i]).all():
            continue
        own = ids[starts[i] : starts[i + 1]]
        mark[own] = 1
        both = np.add.reduceat(mark[ids[starts[i + 1] : starts[end - 1] + n[end - 1]]], starts[i + 1 : end] - starts[i + 1])
        mark[own] = 0
        j = np.flatnonzero((sum(LEAST) * both >= LEAST[0] * (n[i] + n[i + 1 : end])) & (root[i + 1 : end] != root[i])) + i + 1
        if len(j):
            yield i, j


def links_within(rows: DataFrame) -> DataFrame:
    """(a, b) over rows (group, sid, n, root, hashes): a spanning forest of each
    group's links."""

    def run(batches):
        for rows, places in whole_tiles(batches, 1):
            sid, n, root = (rows.column(c).to_numpy(zero_copy_only=False) for c in range(1, 4))
            n, data, found = n.astype(np.int64), rows.column(4), []
            for s, e in places:
                sets = [np.frombuffer(x, "<u8") for x in data.slice(s, e - s).to_pylist()]
                found += [(s + i, s + j) for i, j in joining(e - s, alike_in(n[s:e], root[s:e], sets))]
            if found:
                a, b = np.array(found).T
                yield pa.RecordBatch.from_arrays([pa.array(sid[a]), pa.array(sid[b])], names=["a", "b"])

    ordered = rows.select("group", "sid", "n", "root", "hashes").repartition("group").sortWithinPartitions("group", "n", "sid")
    return ordered.mapInArrow(run, "a long, b long")


def with_partners(rows: DataFrame) -> DataFrame:
    """TILED: those rows of TILED + (map) or (map, prefix) that have a possible
    partner; with prefixes, one that they meet here first."""

    def run(batches):
        for rows, places in whole_tiles(batches):
            block, _, n, root, rest = columns(rows)
            maps = [int.from_bytes(x, "little") for x in rows.column(8).to_pylist()]
            prefixes = [np.frombuffer(x, "<u8") for x in rows.column(9).to_pylist()] if rows.num_columns > 9 else None
            there = np.zeros(rows.num_rows, bool)
            for s, e in places:
                for i, j in partners(n[s:e], rest[s:e], root[s:e], block[s:e], maps[s:e], prefixes and prefixes[s:e]):
                    there[s + i] = True
                    there[s + np.asarray(j)] = True
            if there.any():
                yield rows.select(range(8)).filter(pa.array(there))

    return in_tiles(rows).mapInArrow(run, TILED)


def links_in(rows: DataFrame) -> DataFrame:
    """(a, b) over rows of TILED + (hashes): a spanning forest of each tile's
    links."""

    def run(batches):
        for rows, places in whole_tiles(batches):
            block, sid, n, root, rest = columns(rows)
            sets = [np.frombuffer(x, "<u8") for x in rows.column(8).to_pylist()]
            maps = [int.from_bytes(byte_map(x).tobytes(), "little") for x in sets]
            prefixes = [x[: prefix(len(x))] for x in sets]
            found, above = [], list(range(len(sets)))

            def top(i):
                while above[i] != i:
                    above[i] = i = above[above[i]]
                return i

            for s, e in places:
                for i, partner in partners(n[s:e], rest[s:e], root[s:e], block[s:e], maps[s:e], prefixes[s:e]):
                    for j in partner:
                        i_at, j_at = s + i, s + int(j)
                        a, b = top(i_at), top(j_at)
                        if a != b and sum(LEAST) * common(sets[i_at], sets[j_at]) >= LEAST[0] * (len(sets[i_at]) + len(sets[j_at])):
                            above[a] = b
                            found.append((sid[i_at], sid[j_at]))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*found)], names=["a", "b"])

    return in_tiles(rows).mapInArrow(run, "a long, b long")


def common(x: np.ndarray, y: np.ndarray) -> int:
    """How many values two sorted sets share."""
    at = np.searchsorted(x, y)
    return int((x[np.minimum(at, len(x) - 1)] == y).sum())


def possible(pairs: DataFrame) -> DataFrame:
    """Distinct (a, b) that share enough prefix hashes: whatever else two sets
    share comes after the prefix of one of them, so it is at most the rest of
    the longer set; the least that a link needs is 4/9 of both sizes."""
    rest = F.greatest(*(F.ceil(n * LEAST[0] / LEAST[1] - 1e-9) - 1 for n in (F.col("a_n"), F.col("b_n"))))
    enough = (F.count("*") + F.first("most")) * sum(LEAST) >= LEAST[0] * F.first("sizes")
    pairs = pairs.select("a", "b", rest.alias("most"), (F.col("a_n") + F.col("b_n")).alias("sizes"))
    return pairs.groupBy("a", "b").agg(enough.alias("enough")).where("enough").select("a", "b")


def alike(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of pairs (a, b) that are alike enough, by their whole sets."""
    need = pairs.select(F.explode(F.array("a", "b")).alias("sid")).distinct()
    found = written(sets.join(need, "sid", "left_semi").groupBy("sid").agg(F.first("hashes").alias("hashes")), "sets")
    side = lambda c: found.select(F.col("sid").alias(c), F.col("hashes").alias(f"{c}_hashes"))

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(start, SLICE_ROWS)
                ok = []
                for x, y in zip(part.column(2).to_pylist(), part.column(3).to_pylist()):
                    x, y = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
                    ok.append(sum(LEAST) * common(x, y) >= LEAST[0] * (len(x) + len(y)))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1)], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    out = written(pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "a_hashes", "b_hashes").mapInArrow(run, "a long, b long"), "alike")
    forget(found)
    return out


def near_copies(docs: DataFrame, tile: int = TILE, members: int = MEMBERS, fingerprinted: bool = False) -> DataFrame:
    """linked(), without its shuffle files once it is done."""
    with shuffles_dropped(docs.sparkSession), buckets_kept(docs.sparkSession):
        return linked(docs, tile, members, fingerprinted)


def by_fingerprint(rows: DataFrame) -> DataFrame:
    """(a, b): each set and the least one of its SimHash component (fingerprints
    that are linked at three or fewer differing bits, as simhash.links finds them)."""
    pairs = written(rows.select("sid", "fp").distinct(), "fingerprints")
    roots = components(fingerprint_links(pairs.select("fp").distinct())).select(F.col("vertex").alias("fp"), "root")
    placed = written(pairs.join(roots, "fp", "left").select("sid", F.coalesce("root", "fp").alias("root")), "placed")
    firsts = written(placed.groupBy("root").agg(F.min("sid").alias("first")), "firsts")
    return written(placed.join(firsts, "root").where("sid <> first").select(F.col("first").alias("a"), F.col("sid").alias("b")), "close")


WAYS = [c.split()[0] for c in TILED.split(", ")]


def once(sets: DataFrame, of: DataFrame) -> DataFrame:
    """(sid, n, hashes) of the sets whose sid is in `of`, each once."""
    return sets.join(of.select("sid").distinct(), "sid", "left_semi").groupBy("sid").agg(F.first("n").alias("n"), F.first("hashes").alias("hashes"))


def by_groups(edges: DataFrame, sets: DataFrame, roots: DataFrame, members: int) -> tuple[DataFrame, DataFrame]:
    """((a, b): the links within the components of edges that fit a task, sid of
    the others)."""
    groups = components(edges).select(F.col("vertex").alias("sid"), F.col("root").alias("group"))
    groups = written(groups.join(sets.select("sid", "n").distinct(), "sid"), "groups")
    fits = (F.count("*") <= members) & (F.sum("n") <= MEMBER_HASHES)
    sizes = written(groups.groupBy("group").agg(fits.alias("fits")), "sizes")
    near = groups.join(sizes.where("fits"), "group", "left_semi").join(roots, "sid", "left").select("sid", "group", F.coalesce("root", "sid").alias("root"))
    links = written(links_within(once(sets, near).join(near, "sid")), "links")
    return links, written(groups.join(sizes.where("not fits"), "group", "left_semi").select("sid"), "large")


def by_hashes(held: DataFrame, small: DataFrame) -> DataFrame:
    """(a, b): the links among rows of TILED, met by prefix hash; small has their
    sid, map, prefix and hashes, a row each."""
    kept = written(with_partners(held.join(small.select("sid", "map", "prefix"), "sid").select(*WAYS, "map", "prefix")), "partners")
    part = F.pmod(F.xxhash64("token"), F.lit(SLICES))
    # whole sets are dealt for a slice of the tokens at a time: the disk needed at once is a slice's
    links = [written(links_in(kept.where(part == k).join(small.select("sid", "hashes"), "sid").select(*WAYS, "hashes")), "links") for k in range(SLICES)]
    forget(kept)
    return reduce(DataFrame.unionByName, links)


def linked(docs: DataFrame, tile: int, members: int, fingerprinted: bool) -> DataFrame:
    """(doc_id, text_hash, component_id, stays), a row for each of docs; text_hash
    is xxhash64 of the text. With fingerprinted, SimHash links count too, and what
    they connect isn't compared again. The rows of a component that stay are those of one
    id and text: the least id, then the least hash; one without id only where
    none has an id."""
    rows = stored_rows(shingle_sets(docs, fingerprinted))
    sets = sets_of(rows)
    close = by_fingerprint(rows) if fingerprinted else None
    tokens = written(shared(prefixes(sets)), "tokens")
    fits = LEAST[1] * F.least("n", "first_n") >= LEAST[0] * F.greatest("n", "first_n")
    tried = tokens.where("sid <> first").where(fits).select(F.col("first").alias("a"), F.col("sid").alias("b"), F.col("first_n").alias("a_n"), F.col("n").alias("b_n"))
    tried = written(possible(tried), "tried")  # a pair that has other tokens too is counted whole in rest
    hubs = alike(tried, sets)
    forget(tried)
    if close is not None:
        hubs = hubs.unionByName(close)
    roots = components(hubs).select(F.col("vertex").alias("sid"), "root")
    rooted = tokens.select("token", "sid", "n", "rest").join(roots, "sid", "left").withColumn("root", F.coalesce("root", "sid"))
    held = written(tiled(rooted, tile), "tiles")
    forget(tokens)
    small = written(maps_and_prefixes(once(sets, held)).select("sid", "map"), "maps")
    edges = written(candidates(held.join(small, "sid").select(*WAYS, "map")).distinct(), "candidates")
    more, large = by_groups(edges, sets, roots, members)
    if not large.isEmpty():
        before, held = held, written(with_partners(held.join(large, "sid", "left_semi").join(small, "sid").select(*WAYS, "map")), "partners")
        forget(before)
        wide = written(wide_maps(once(sets, held)), "wide")
        edges = written(candidates(held.join(small, "sid").join(wide, "sid").select(*WAYS, "map", "wide")).distinct(), "candidates")
        forget(wide)
        parted, large = by_groups(edges, sets, roots, members)
        more = more.unionByName(parted)
    if not large.isEmpty():
        whole = written(once(sets, large), "whole")
        prefix_of = written(maps_and_prefixes(whole).join(whole.select("sid", "hashes"), "sid"), "prefixes")
        forget(whole)
        more = more.unionByName(by_hashes(held.join(large, "sid", "left_semi"), prefix_of))
        forget(prefix_of)
    forget(held, small)
    roots = components(hubs.unionByName(more)).select(F.col("vertex").alias("sid"), "root")
    place = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("text_hash"))
    least = rows.groupBy("sid").agg(F.min(place).alias("least"))
    least = written(least.join(roots, "sid", "left").select("sid", "least", F.coalesce("root", "sid").alias("root")), "least")
    firsts = written(least.groupBy("root").agg(F.min("least").alias("first")), "firsts")
    own = written(least.join(firsts, "root").select("sid", "first"), "components")
    stays = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_hash") == F.col("first.text_hash"))
    return rows.select("doc_id", "text_hash", "sid").join(own, "sid").select("doc_id", "text_hash", F.col("first.doc_id").alias("component_id"), stays.alias("stays"))
