"""Commits over tables, keyed tables, results and what is resumed."""

import random

import pytest
from pyspark.sql import functions as F

from paperloom.operators import store, workflow
from paperloom.sources.tablestore import Conflict, TableStore, marker
from paperloom.streaming.checkpoints import KeyedTable, current, upsert_stream

SCHEMAS = {"papers": "paper_id string, status string", "items": "paper_id string, n int"}


def rows(df):
    return sorted(map(tuple, df.collect()))


@pytest.fixture()
def tables(spark, tmp_path):
    out = TableStore(spark, str(tmp_path / "store"))
    out.create(SCHEMAS)
    out.commit("load", {"papers": spark.createDataFrame([("a", "parsing"), ("b", "parsing")], SCHEMAS["papers"]), "items": spark.createDataFrame([("a", 1), ("b", 2)], SCHEMAS["items"])})
    return out


def both(tables):
    return rows(tables.table("papers")), rows(tables.table("items"))


LOADED = ([("a", "parsing"), ("b", "parsing")], [("a", 1), ("b", 2)])


def test_tables_are_made_once(spark, tables):
    tables.create({**SCHEMAS, "more": "x int"})
    tables.create({**SCHEMAS, "more": "x int"})
    assert both(tables) == LOADED and tables.table("more").count() == 0 and tables.schema("papers").fieldNames() == ["paper_id", "status"]


def test_a_session_is_all_or_nothing(spark, tables):
    with pytest.raises(ZeroDivisionError), tables.session("bad") as s:
        s.replace("papers", tables.table("papers").limit(0))
        1 / 0
    assert both(tables) == LOADED
    with tables.session("good") as s:
        s.replace("papers", tables.table("papers").withColumn("status", F.lit("ready")))
        s.append("items", spark.createDataFrame([("a", 3)], SCHEMAS["items"]))
    assert both(tables) == ([("a", "ready"), ("b", "ready")], [("a", 1), ("a", 3), ("b", 2)])


def test_a_crash_between_tables_shows_the_old_state(spark, tables):
    """The first table is written, the second can't be: no manifest names either."""
    broken = spark.createDataFrame([("a", 3)], SCHEMAS["items"]).withColumn("n", F.raise_error(F.lit("crash")).cast("int"))
    for _ in range(2):
        with pytest.raises(Exception, match="crash"):
            tables.commit("half", {"papers": tables.table("papers").limit(0), "items": broken})
        assert both(tables) == LOADED
    before = len(tables.folder.names("tables/papers"))
    tables.vacuum()
    assert len(tables.folder.names("tables/papers")) < before and both(tables) == LOADED
    assert tables.commit("half", {"items": spark.createDataFrame([("z", 9)], SCHEMAS["items"])}) and both(tables)[1] == [("z", 9)]


def test_a_commit_is_made_once(spark, tables):
    more = {"items": spark.createDataFrame([("c", 3)], SCHEMAS["items"])}
    assert [tables.commit("more", append=more) for _ in range(3)] == [True, False, False]
    # its writer died before the marker was there
    tables.folder.remove(marker("more"))
    assert not tables.commit("more", append=more)
    tables.folder.remove(marker("more"))
    assert tables.commit("other", append=more) and not tables.commit("more", append=more)
    assert rows(tables.table("items")) == [("a", 1), ("b", 2), ("c", 3), ("c", 3)]


def test_of_two_writers_one_fails(spark, tables):
    before = tables.state()
    tables.commit("first", append={"items": spark.createDataFrame([("c", 3)], SCHEMAS["items"])})
    with pytest.raises(Conflict):
        tables.publish(before, "second", before.tables)
    assert rows(tables.table("items")) == [("a", 1), ("b", 2), ("c", 3)] and not tables.folder.names("drafts")
    assert rows(tables.table("items", before)) == [("a", 1), ("b", 2)]  # the older state is still there


def test_keyed_tables_against_plain_code(spark, tmp_path):
    """Late rows, repeated batches, ties; few parts stay."""
    rng = random.Random(2)
    table, want = KeyedTable(spark, str(tmp_path / "t"), fanout=2), {}
    table.create("k string, n int, v string", ["k"], ["n"])
    for number in range(9):
        batch = [(rng.choice("abcdefghijkl"), rng.randrange(30), rng.choice("xyz")) for _ in range(rng.choice([1, 3, 12]))]
        df = spark.createDataFrame(batch, "k string, n int, v string")
        assert table.upsert(f"q {number}", df) and not table.upsert(f"q {number}", df)
        for k, n, v in batch:
            want[k] = max(want.get(k, (-1, "")), (n, v))
        assert rows(table.read()) == sorted((k, n, v) for k, (n, v) in want.items())
        assert len(table.parts()) <= 5
    assert len(table.store.folder.names("tables/rows")) <= 8  # old parts go


def test_streams_of_several_batches(spark, tmp_path):
    schema, seen = "k string, n int, v string", []
    for k, batch in enumerate([[("a", 5, "x"), ("b", 1, "y")], [("a", 2, "late")], [("b", 2, "z"), ("c", 1, "w")]]):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    assert current(spark, str(tmp_path / "t")) is None
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    upsert_stream(stream, str(tmp_path / "t"), str(tmp_path / "c"), ["k"], ["n"], lambda number, parts: seen.append(number)).awaitTermination()
    assert seen == [0, 1, 2] and rows(current(spark, str(tmp_path / "t"))) == [("a", 5, "x"), ("b", 2, "z"), ("c", 1, "w")]
    # a query with a new checkpoint is another one: its batches count again
    upsert_stream(stream, str(tmp_path / "t"), str(tmp_path / "c2"), ["k"], ["n"]).awaitTermination()
    assert rows(current(spark, str(tmp_path / "t"))) == [("a", 5, "x"), ("b", 2, "z"), ("c", 1, "w")]


def plain_reconcile(items, results):
    errors, first = [], {}
    for paper, item, index, status, arrival in sorted(results, key=lambda r: r[4]):
        if item is None:
            errors.append((paper, None, "no_work_item_id"))
        elif item not in items:
            errors.append((paper, item, "unexpected_work_item_id"))
        elif item in first:
            errors.append((paper, item, "duplicate_result"))
        elif index != items[item][1]:
            errors.append((paper, item, "wrong_question_index"))
        else:
            first[item] = status
    out = [(paper, item, index, str(index), first.get(item, "failed")) for item, (paper, index) in items.items()]
    return sorted(out), sorted(errors + [(paper, item, "no_result") for item, (paper, _) in items.items() if item not in first], key=repr)


def test_reconcile_against_plain_code(spark):
    rng = random.Random(4)
    items = {f"p{k % 3}:q:{k:04d}": (f"p{k % 3}", k) for k in range(40)}
    known = list(items)
    results = []
    for arrival in range(120):
        item = rng.choice([*known, None, "p0:q:9999"] if rng.random() < 0.3 else known)
        index = items[item][1] if item in items else 0
        results.append((items[item][0] if item in items else "p0", item, index + (rng.random() < 0.2), rng.choice(["completed", "failed"]), arrival))
    got = workflow.reconciled(spark.createDataFrame([(p, i, k, str(k)) for i, (p, k) in items.items()], "paper_id string, work_item_id string, question_index int, number string"), spark.createDataFrame(results, "paper_id string, work_item_id string, question_index int, status string, arrival int"))
    want = plain_reconcile(items, results)
    assert rows(got[0]) == want[0] and sorted(map(tuple, got[1].collect()), key=repr) == want[1]


def test_what_is_resumed(spark):
    solved = spark.createDataFrame([("p", 1, "1", "x", None, None, None, None, True), ("q", 2, "1", "y", ["s"], [], 0.9, "review", False)], "paper_id string, id long, question_number string, answer string, steps array<string>, mark_split array<struct<marks:int,`for`:string>>, confidence double, verified_by string, needs_teacher_check boolean")
    got = store.resume_rows(solved, spark.createDataFrame([("p",), ("q",)], "paper_id string")).orderBy("id").collect()
    assert [(r.verified_by, r.steps, r.mark_split, r.confidence) for r in got] == [("checkpoint:db", [], [], 0.0), ("checkpoint:review", ["s"], [], 0.9)]
    papers = spark.createDataFrame([("p", "f1", "ready"), ("q", "f2", "failed")], "paper_id string, fingerprint string, status string")
    wanted = spark.createDataFrame([("f1",), ("f2",), ("f3",)], "fingerprint string")
    assert [r.paper_id for r in store.paper_by_fingerprint(papers, wanted).collect()] == ["p"]
