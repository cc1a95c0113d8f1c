"""Checkpoints from a stream: each micro-batch is upserted into a keyed table.

A batch is written as a part of its own, one row for each key; what a key's last
row is, is found when the table is read. Parts are merged in tiers by their size:
`fanout` parts of a tier become one of the next, so each row is rewritten a number
of times that grows with the logarithm of the table, not with every batch.

foreachBatch may repeat a batch after a failure. A batch is a commit of the store,
named by the query and the batch's number, and a commit that was made does
nothing when it is repeated. Late rows lose to those that follow them in `order`,
in whichever batch they come."""

from __future__ import annotations

import json
import math
from collections import defaultdict
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.store import latest
from ..sources.tablestore import Folder, Part, TableStore

ROWS, FANOUT = "rows", 4


class KeyedTable:
    """The last row of each key by `order`, in a store at `path`."""

    def __init__(self, spark: SparkSession, path: str, fanout: int = FANOUT):
        self.store, self.fanout = TableStore(spark, path), fanout

    def create(self, schema, keys: list[str], order: list[str]) -> None:
        self.store.create({ROWS: schema}, {ROWS: {"keys": keys, "order": order}})

    def last(self, rows: DataFrame) -> DataFrame:
        notes = self.store.state().tables[ROWS].notes
        return latest(rows, notes["keys"], notes["order"])

    def read(self) -> DataFrame:
        return self.last(self.store.table(ROWS))

    def parts(self) -> tuple[Part, ...]:
        return self.store.state().tables[ROWS].parts

    def upsert(self, commit: str, batch: DataFrame) -> bool:
        """Adds a batch, once; False where it was there."""
        done = self.store.commit(commit, append={ROWS: self.last(batch)})
        self.compact()
        return done

    def tier(self, part: Part) -> int:
        return int(math.log(max(1, part.rows), self.fanout))

    def compact(self) -> None:
        """Merges the parts of the lowest tier that is full with all smaller ones,
        until no tier is full."""
        while True:
            tiers = defaultdict(list)
            for p in self.parts():
                tiers[self.tier(p)].append(p)
            full = min((t for t, found in tiers.items() if len(found) >= self.fanout), default=None)
            if full is None:
                return
            gone = [p for t, found in tiers.items() if t <= full for p in found]
            schema = self.store.schema(ROWS)
            rows = self.store.spark.read.schema(schema).parquet(*(f"{self.store.folder.path}/{p.path}" for p in gone))
            self.store.swap(ROWS, gone, self.last(rows))
            self.store.vacuum()


def current(spark: SparkSession, path: str) -> DataFrame | None:
    """The rows of a keyed table; None where there is none."""
    table = KeyedTable(spark, path)
    return table.read() if ROWS in table.store.state().tables else None


def query_id(spark: SparkSession, checkpoint: str) -> str:
    """What a streaming query keeps over its restarts, from its checkpoint."""
    return json.loads(Folder(spark, checkpoint).text("metadata"))["id"]


def upsert_stream(stream: DataFrame, path: str, checkpoint: str, keys: list[str], order: list[str], progress: Callable[[int, int], None] | None = None, fanout: int = FANOUT) -> StreamingQuery:
    """Keeps the last row of each key by `order`, over all batches; progress is
    called with each batch's number and the parts that the table has then."""

    def upsert(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        table = KeyedTable(spark, path, fanout)
        table.create(batch.schema, keys, order)
        table.upsert(f"{query_id(spark, checkpoint)} {number}", batch)
        if progress:
            progress(number, len(table.parts()))

    return stream.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
