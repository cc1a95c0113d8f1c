"""Every registered query of the engine against its DuckDB SQL."""

import os

import duckdb
import pytest

from paperloom.operators import diagnostics
from paperloom.operators.dealing import TASK_ROWS, dealt
from paperloom.plans import catalog
from paperloom.plans import shapes as S

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", catalog.QUERIES)
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    assert got
    if name in catalog.ORACLE_SQL:
        want = duck.sql(catalog.ORACLE_SQL[name])
        assert sorted(want.columns) == columns
        at = [want.columns.index(c) for c in columns]
        assert got == sorted((tuple(plain(r[k]) for k in at) for r in want.fetchall()), key=repr)


def test_results_do_not_depend_on_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        rows = []
        for n in ("1", "16"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            rows.append(sorted(map(repr, catalog.QUERIES["quality_report"](spark, SF).collect())))
        assert rows[0] == rows[1]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_reconcile_deals_once_by_item(spark):
    plan = catalog.QUERIES["reconcile"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(work_item_id") == 1 and "Join" not in plan


def test_lines_are_dealt_once(spark):
    """Grouping by paper follows the deal that the lines came by (a new one would hold all groups in the session's few tasks)."""
    for name in ("line_classes", "declared_counts", "segment_papers"):
        plan = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1, plan


def test_report_deals_questions_and_papers_once(spark):
    """All rules share one deal by paper, to as many tasks as the rows need; the gate deals its papers' ids besides."""
    plan = catalog.QUERIES["report_gate"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(paper_id") == plan.count("Exchange hashpartitioning") <= 3 and plan.count("lineitem.parquet") == 1, plan
    size = 9 * TASK_ROWS
    found = diagnostics.report(dealt(S.order_papers(spark, SF), "paper_id", size=size), S.order_questions(spark, SF, size))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == plan.count(", 9), REPARTITION_BY_NUM") == 2, plan
