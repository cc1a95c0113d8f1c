"""Sharding by a permutation-filled lookup table.

Every shard has a preference order over the slots of a table of prime size: it
starts at an offset and goes on by a skip, both from its name's digest. Shards
take turns claiming their next free slot until the table is full, so each holds
size / shards slots give or take one, and few slots change hands when a shard
comes or goes. A key's digest modulo size is its slot.

Native. The table is filled once on the driver (its size is a parameter, not
the data's) and broadcast: placing a row is one hash and one lookup, with no
shuffle, so no key, however frequent, gathers rows anywhere.

Defined results: a null key is placed by the digest of an empty string; equal
keys go to one shard; repeated rows keep their rows; an empty table gives no
row; further columns stay, but for
those named slot or shard, which are replaced.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

SLOTS = 16381
SHARDS = tuple(f"shard-{k:03d}" for k in range(64))


def fill(shards: tuple[str, ...], slots: int = SLOTS) -> list[int]:
    """The shard's place in `shards` for each slot."""
    if not shards or len(set(shards)) < len(shards) or len(shards) > slots or slots < 2 or any(slots % d == 0 for d in range(2, int(slots**0.5) + 1)):
        raise ValueError("shards must be distinct, at most slots, and slots a prime")
    digests = [hashlib.md5(s.encode()).hexdigest() for s in shards]
    at = [int(d[:16], 16) % slots for d in digests]
    skip = [int(d[16:], 16) % (slots - 1) + 1 for d in digests]
    out, left = [-1] * slots, slots
    while True:
        for k in range(len(shards)):
            while out[at[k]] >= 0:
                at[k] = (at[k] + skip[k]) % slots
            out[at[k]] = k
            left -= 1
            if not left:
                return out


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    digest = F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 15)
    return F.pmod(F.conv(digest, 16, 10).cast("long"), F.lit(slots).cast("long"))


def sharded(df: DataFrame, key: str = "doc_id", shards: tuple[str, ...] = SHARDS, slots: int = SLOTS) -> DataFrame:
    """df with slot and shard added, in place of columns of these names."""
    spark = df.sparkSession
    names = F.from_json(F.lit(json.dumps(list(shards))), "array<string>")
    lookup = spark.range(1).select(F.posexplode(F.from_json(F.lit(json.dumps(fill(tuple(shards), slots))), "array<int>")).alias("slot", "n")).select(F.col("slot").cast("long").alias("slot"), F.get(names, F.col("n")).alias("shard"))
    own = [c for c in df.columns if c not in ("slot", "shard")]
    rows = df.select(F.struct(*df.columns).alias("row"), slot_of(F.col(key), slots).alias("slot"))
    # `slots` rows, by parameter
    return rows.join(F.broadcast(lookup), "slot").select(*(F.col("row")[c].alias(c) for c in own), "slot", "shard")


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharded(table(spark, sf_dir, "documents").select("doc_id"))


ORACLE_SQL = f"""
WITH filled AS (SELECT unnest({json.dumps(fill(SHARDS))}) AS n, unnest(range({SLOTS})) AS slot),
placed AS (
  SELECT doc_id, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT % {SLOTS} AS slot
  FROM documents)
SELECT doc_id, p.slot, 'shard-' || lpad(n::VARCHAR, 3, '0') AS shard
FROM placed p JOIN filled f ON p.slot = f.slot
"""
