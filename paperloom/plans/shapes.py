"""The driver tables in the shapes the operators work on.

An order is a paper and its line items are questions: dirty numbering, repeats
and gaps. lineitem has no row order, so a total order over all its columns is
the document order. A conversation is a clean paper. Lines of papers are written
from line items; running heads from a customer's orders.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.dealing import dealt

ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
SQL_ORDER = ", ".join(ORDER)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def order_questions(spark: SparkSession, sf_dir: str, size: int | None = None) -> DataFrame:
    """Questions of the canonical shape; marks are unknown where the quantity
    is divisible by 13. Dealt by paper_id (to as many tasks as `size` rows need)."""
    rows = dealt(table(spark, sf_dir, "lineitem").withColumn("paper_id", F.col("l_orderkey").cast("string")), "paper_id", size=size)
    at = F.row_number().over(Window.partitionBy("paper_id").orderBy(*ORDER)) - 1
    quantity = F.col("l_quantity").cast("int")
    return rows.select(
        "paper_id", at.alias("question_index"), F.col("l_linenumber").cast("string").alias("number"), F.col("l_returnflag").alias("section"),
        F.concat(F.lit("Find the value of part "), F.col("l_partkey").cast("string")).alias("text"), F.when(quantity % 13 != 0, quantity).alias("marks"), F.lit("numerical").alias("type"),
        F.lit(None).cast("array<string>").alias("options"), F.lit(False).alias("has_figure"), F.lit(1).alias("page"),
    )


SQL_QUESTIONS = f"""questions AS (
  SELECT l_orderkey::VARCHAR AS paper_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY {SQL_ORDER}) - 1 AS question_index,
         l_linenumber::VARCHAR AS number, l_returnflag AS section, 'Find the value of part ' || l_partkey AS text,
         CASE WHEN l_quantity::INT % 13 <> 0 THEN l_quantity::INT END AS marks, 1 AS page
  FROM lineitem)"""


def order_papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Papers that declare something: totals from the order's price."""
    o = table(spark, sf_dir, "orders")
    price = F.floor("o_totalprice").cast("int")
    return o.select(F.col("o_orderkey").cast("string").alias("paper_id"), (price % 200).alias("declared_total_marks"), (price % 7 + 1).alias("declared_question_count"), (price % 5 + 1).alias("total_questions"), F.lit(1).alias("total_pages"), F.when(price % 3 == 0, F.array(F.lit("A"), F.lit("N"))).otherwise(F.array().cast("array<string>")).alias("declared_sections"), "o_orderstatus")


SQL_PAPERS = """papers AS (
  SELECT o_orderkey::VARCHAR AS paper_id, floor(o_totalprice)::INT % 200 AS declared_total_marks,
         floor(o_totalprice)::INT % 7 + 1 AS declared_question_count, floor(o_totalprice)::INT % 5 + 1 AS total_questions,
         floor(o_totalprice)::INT % 3 = 0 AS declares, o_orderstatus
  FROM orders)"""


def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(paper_id, page, line_no, text): a heading where the section changes, an
    instruction at the start of a section, the item, its bare marks. Dealt by
    paper_id, so that what groups by it deals nothing again."""
    rows = dealt(table(spark, sf_dir, "lineitem").withColumn("paper_id", F.col("l_orderkey").cast("string")), "paper_id")
    w = Window.partitionBy("paper_id").orderBy(*ORDER)
    rows = rows.withColumn("place", F.row_number().over(w)).withColumn("before", F.lag("l_returnflag").over(w))
    turn = F.coalesce(F.col("before") != F.col("l_returnflag"), F.lit(True))
    item = F.concat(F.col("l_linenumber").cast("string"), F.lit(" Find the value of part "), F.col("l_partkey").cast("string"), F.lit("?"))
    said = F.array(F.when(turn, F.concat(F.lit("Section "), F.col("l_returnflag"))), F.when(turn, F.concat(F.lit("Attempt all "), F.col("l_linenumber").cast("string"), F.lit(" questions. Each carries 3 marks."))), item, F.col("l_quantity").cast("int").cast("string"))
    lines = rows.select("paper_id", F.lit(1).alias("page"), "place", (F.array(turn, turn, F.lit(True), F.lit(True))).alias("there"), F.posexplode(said).alias("k", "text"))
    return lines.where(F.get("there", F.col("k"))).select("paper_id", "page", (F.col("place") * 10 + F.col("k") + 1).cast("int").alias("line_no"), "text")


SQL_LINES = f"""ordered AS (
  SELECT *, row_number() OVER w AS place, lag(l_returnflag) OVER w AS before FROM lineitem
  WINDOW w AS (PARTITION BY l_orderkey ORDER BY {SQL_ORDER})),
lines AS (
  SELECT l_orderkey::VARCHAR AS paper_id, 1 AS page, place * 10 + 1 AS line_no, 'Section ' || l_returnflag AS text FROM ordered WHERE before IS NULL OR before <> l_returnflag
  UNION ALL SELECT l_orderkey::VARCHAR, 1, place * 10 + 2, 'Attempt all ' || l_linenumber || ' questions. Each carries 3 marks.' FROM ordered WHERE before IS NULL OR before <> l_returnflag
  UNION ALL SELECT l_orderkey::VARCHAR, 1, place * 10 + 3, l_linenumber || ' Find the value of part ' || l_partkey || '?' FROM ordered
  UNION ALL SELECT l_orderkey::VARCHAR, 1, place * 10 + 4, l_quantity::INT::VARCHAR FROM ordered)"""


def customer_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's orders as pages with a running head, a header line, a body
    line and a footer."""
    o = dealt(table(spark, sf_dir, "orders"), "o_custkey")
    page = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    rows = o.withColumn("page", page).withColumn("pages", F.count("*").over(Window.partitionBy("o_custkey")))
    s = lambda c: F.col(c).cast("string")
    said = F.array(F.concat(F.lit("Customer test series "), s("o_custkey")), F.concat(F.lit("Subject: Orders "), F.col("o_orderstatus"), F.lit("  |  Class: "), s("o_custkey")), F.concat(F.lit("Total Marks: "), (F.floor("o_totalprice").cast("int") % 100).cast("string"), F.lit("  |  Time Allowed: 3h  |  CBSE")), F.concat(F.lit("Order "), s("o_orderkey"), F.lit(" is "), F.col("o_orderpriority"), F.lit(".")), F.concat(F.lit("Page "), s("page"), F.lit("/"), s("pages")))
    return rows.select(s("o_custkey").alias("paper_id"), "page", F.posexplode(said).alias("pos", "text")).select("paper_id", "page", (F.col("pos") + 1).alias("line_no"), "text")


SQL_PAGES = """paged AS (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS page, count(*) OVER (PARTITION BY o_custkey) AS pages FROM orders),
pages_ AS (
  SELECT o_custkey::VARCHAR AS paper_id, page, pages, unnest(range(1, 6)) AS line_no, unnest([
    'Customer test series ' || o_custkey, 'Subject: Orders ' || o_orderstatus || '  |  Class: ' || o_custkey,
    'Total Marks: ' || (floor(o_totalprice)::INT % 100) || '  |  Time Allowed: 3h  |  CBSE',
    'Order ' || o_orderkey || ' is ' || o_orderpriority || '.', 'Page ' || page || '/' || pages]) AS text
  FROM paged)"""


def solved_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a label as solved questions; some are weak."""
    d, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    from ..functions.identity import question_signature

    rows = d.join(labels, "doc_id")
    return rows.select(F.col("source").alias("paper_id"), F.concat(F.lit("w"), F.col("doc_id").cast("string")).alias("work_item_id"), F.col("doc_id").alias("id"), question_signature(F.col("text")).alias("question_signature"), (F.col("toxic") == 1).alias("needs_teacher_check"), F.when(F.col("quality") == 1, "passed").otherwise("failed").alias("verification_status"), F.when(F.col("doc_id") % 11 != 0, "model").alias("model_used"), F.lit("p1").alias("prompt_version"), (F.lit(1.0) - (F.col("doc_id") % 4) / 20).alias("confidence"), F.concat(F.lit("a"), F.col("doc_id").cast("string")).alias("answer"), F.lit("m").alias("verified_by"))


NORM = r"""regexp_replace(trim(regexp_replace(regexp_replace(translate(lower(coalesce(text, '')), '“”‘’—–−' || chr(160), '""''''---' || ' '),
  '^(?:q(?:uestion)?\s*\.?\s*\d+\s*[:\.\-\)]|\d+\s*[:\.\-\)])\s*', ''), '\s+', ' ', 'g')), '[.:\s]+$', '')"""
SIGNATURE = f"sha256('v2|' || {NORM} || '|0|CBSE||||figure=0')"
SQL_SOLVED = f"""solved AS (
  SELECT d.source AS paper_id, 'w' || doc_id AS work_item_id, doc_id AS id, {SIGNATURE} AS question_signature,
         l.toxic = 1 AS needs_teacher_check, CASE WHEN l.quality = 1 THEN 'passed' ELSE 'failed' END AS verification_status,
         CASE WHEN doc_id % 11 <> 0 THEN 'model' END AS model_used, 1.0 - (doc_id % 4) / 20 AS confidence, 'a' || doc_id AS answer
  FROM documents d JOIN labels l USING (doc_id))"""
