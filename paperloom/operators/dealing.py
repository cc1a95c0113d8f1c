"""How rows are dealt to tasks where a paper's rows must meet in order."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Rows that a task sorts. More rows are more tasks, not larger ones.
TASK_ROWS = 1 << 19


def dealt(rows: DataFrame, *keys: str, size: int | None = None, task_rows: int = TASK_ROWS) -> DataFrame:
    """rows dealt by keys, to as many tasks as `size` rows need (they are counted
    if it isn't given), and to the session's number at least."""
    needed = -(-(rows.count() if size is None else size) // task_rows)
    if needed <= int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        return rows.repartition(*keys)
    return rows.repartition(needed, *keys)
