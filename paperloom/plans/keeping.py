"""Queries of what is kept: commits, keyed tables from streams, results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import pages, store, workflow
from ..sources.tablestore import TableStore
from ..streaming.checkpoints import current, upsert_stream
from . import shapes as S
from .registry import query, shared_folder


class Crash(RuntimeError):
    """Stands for what ends a session too early."""


@query("""WITH kept AS (SELECT * FROM orders WHERE o_orderpriority NOT LIKE '1%'),
lines AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1)
SELECT o_orderkey AS paper_id, CASE WHEN o_orderstatus = 'F' THEN 'ready' ELSE 'parsing' END AS status, coalesce(n, 0) + 1 AS items FROM kept LEFT JOIN lines ON l_orderkey = o_orderkey""")
def store_commits(spark, sf_dir):
    """Orders and their lines as tables that change together (S11, S12): a load, an
    update, a cascade, each repeated; a session that fails after its first table;
    a row more for each paper, appended."""
    tables = TableStore(spark, shared_folder(spark, "store"))
    schemas = {"papers": "paper_id long, status string, doomed boolean", "items": "paper_id long, number int"}
    for _ in range(2):
        tables.create(schemas)
    o, lines = S.table(spark, sf_dir, "orders"), S.table(spark, sf_dir, "lineitem")
    load = {"papers": o.select(F.col("o_orderkey").alias("paper_id"), F.lit("parsing").alias("status"), F.col("o_orderpriority").startswith("1").alias("doomed")), "items": lines.select(F.col("l_orderkey").alias("paper_id"), F.col("l_linenumber").alias("number"))}
    marks = o.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("paper_id"), F.lit("ready").alias("status"))
    for _ in range(2):
        tables.commit("load", load)
        tables.commit("mark", {"papers": store.mark_status(tables.table("papers"), marks)})
        kept = store.without_papers(tables.table("papers"), tables.table("items"), tables.table("papers").where("doomed"))
        with tables.session("cascade") as s:
            s.replace("papers", kept[0])
            s.replace("items", kept[1])
        tables.commit("more", append={"items": tables.table("papers").select("paper_id", F.lit(0).alias("number"))})
    try:
        with tables.session("lost") as s:
            s.replace("papers", tables.table("papers").limit(0))
            raise Crash
    except Crash:
        pass
    counts = tables.table("items").groupBy("paper_id").agg(F.count("*").alias("items"))
    return tables.table("papers").join(counts, "paper_id", "left").select("paper_id", "status", "items")


@query("SELECT user_id, event_type, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY 1, 2")
def stream_checkpoint(spark, sf_dir):
    """Events in micro-batches that each span all times, so that late rows come,
    and every tenth comes twice: the last of each user and type."""
    path = shared_folder(spark, "stream")
    events = S.table(spark, sf_dir, "events")
    events.unionByName(events.where("event_id % 10 = 0")).repartition(7, F.rand(1)).write.parquet(f"{path}/in")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    upsert_stream(stream, f"{path}/table", f"{path}/checkpoint", ["user_id", "event_type"], ["ts", "event_id"], fanout=2).awaitTermination()
    return current(spark, f"{path}/table").select("user_id", "event_type", "event_id", "value")


def order_results(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Items of orders, and results of which some are lost, doubled, of a wrong
    index, of unknown items or without an id."""
    items = workflow.work_items(S.order_questions(spark, sf_dir)).select("paper_id", "work_item_id", "question_index", "number")
    part = (F.col("paper_id").cast("long") * 7 + F.col("question_index")) % 10
    sent = items.where(part != 0).select("paper_id", F.when(part == 1, F.concat("work_item_id", F.lit("?"))).when(part != 2, F.col("work_item_id")).alias("work_item_id"), F.when(part == 3, F.col("question_index") + 1).otherwise(F.col("question_index")).alias("question_index"), F.when(part == 4, "failed").otherwise("completed").alias("status"), F.lit(1).alias("arrival"))
    twice = items.where(part == 5).select("paper_id", "work_item_id", "question_index", F.lit("failed").alias("status"), F.lit(2).alias("arrival"))
    return items, sent.unionByName(twice)


@query(f"""WITH {S.SQL_QUESTIONS}, parts AS (SELECT paper_id, (paper_id::BIGINT * 7 + question_index) % 10 AS part FROM questions),
wrong AS (SELECT paper_id, unnest(CASE part WHEN 0 THEN ['no_result'] WHEN 1 THEN ['unexpected_work_item_id', 'no_result'] WHEN 2 THEN ['no_work_item_id', 'no_result'] WHEN 3 THEN ['wrong_question_index', 'no_result'] WHEN 5 THEN ['duplicate_result'] ELSE [] END) AS error FROM parts),
told AS (SELECT paper_id, count(*) AS errors, array_to_string(list_sort(list_distinct(list(error))), ',') AS kinds FROM wrong GROUP BY 1)
SELECT paper_id, count(*) AS items, count(*) FILTER (part <= 4) AS failed, coalesce(any_value(errors), 0) AS errors, coalesce(any_value(kinds), '') AS kinds FROM parts LEFT JOIN told USING (paper_id) GROUP BY paper_id""")
def reconcile(spark, sf_dir):
    rows = workflow.matched(*order_results(spark, sf_dir))
    item = F.col("row") == workflow.ITEM
    kinds = F.array_join(F.array_sort(F.collect_set("error")), ",")
    return rows.groupBy("paper_id").agg(F.count_if(item).alias("items"), F.count_if(item & (F.col("status") == "failed")).alias("failed"), F.count("error").alias("errors"), kinds.alias("kinds"))


@query(f"""WITH {S.SQL_SOLVED} SELECT paper_id, id, 'q' || id AS question_number, answer, confidence, 'checkpoint:db' AS verified_by, needs_teacher_check FROM solved WHERE paper_id IN (SELECT source FROM documents WHERE doc_id % 3 = 0)""")
def resume_rows(spark, sf_dir):
    """What is solved already of some papers (R6)."""
    d = S.table(spark, sf_dir, "documents")
    solved = S.solved_store(spark, sf_dir).withColumns({"question_number": F.concat(F.lit("q"), F.col("id").cast("string")), "verified_by": F.lit(None).cast("string")})
    return store.resume_rows(solved, d.where("doc_id % 3 = 0").select(F.col("source").alias("paper_id"))).select("paper_id", "id", "question_number", "answer", "confidence", "verified_by", "needs_teacher_check")


@query(f"""WITH {S.SQL_PAGES} SELECT paper_id, trim('Orders ' || arg_min(o_orderstatus, page)) AS subject, paper_id AS class, 'CBSE' AS board
FROM pages_ JOIN (SELECT o_custkey::VARCHAR AS c, o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS p FROM orders) ON c = paper_id AND p = page GROUP BY paper_id""")
def header_views(spark, sf_dir):
    """The three facts that a paper is filed under (T27)."""
    return pages.header_view(S.customer_pages(spark, sf_dir))
