"""The registered queries of the document engine and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.arithmetic import safe_calculate
from ..functions.scoring import confidence, payload_errors
from ..functions.text import carried_marks, declared_count, figure_flag, is_instruction, line_class, normalize_text, option_groups, promotable, question_type, section_label, text_key, trailing_marks
from ..functions.context import question_context
from ..functions.identity import question_signature
from ..operators import diagnostics, ingest, pages, segment, store, vision, workflow
from ..operators.dealing import dealt
from ..sources.provider import OfflineProvider
from ..sources.readers import lines_of_texts
from . import keeping, reading  # noqa: F401  register their queries
from . import shapes as S
from .registry import ORACLE_SQL, QUERIES, cut, query, quoted  # noqa: F401

KEY = "substr(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9]+', '', 'g'), 1, 160)"


@query(r"""
WITH l AS (SELECT doc_id, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line_no, unnest(string_split(text, chr(10))) AS line FROM documents)
SELECT doc_id, line_no, regexp_replace(replace(line, chr(160), ' '), '^\s+|\s+$', '', 'g') AS text FROM l
WHERE regexp_replace(replace(line, chr(160), ' '), '^\s+|\s+$', '', 'g') <> ''""")
def lines_scan(spark, sf_dir):
    return lines_of_texts(S.table(spark, sf_dir, "documents"), "doc_id")


@query(f"SELECT {KEY} AS key, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1 AND {KEY} <> ''")
def text_key_duplicates(spark, sf_dir):
    return S.table(spark, sf_dir, "documents").groupBy(text_key(F.col("text")).alias("key")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).where("n > 1 and key <> ''")


@query(f"""WITH {S.SQL_PAGES},
counted AS (SELECT *, (SELECT count(DISTINCT page) FROM pages_ p WHERE p.paper_id = q.paper_id AND p.text = q.text) AS on_pages FROM pages_ q)
SELECT paper_id, page, line_no, text FROM counted
WHERE pages < 2 OR NOT (regexp_matches(text, {quoted(P.PAGE_FOOTER)}) OR
  (on_pages >= greatest(2, ceil(pages * 0.6)) AND length(text) <= 60 AND NOT regexp_matches(text, {quoted(P.SENTENCE_END)}) AND NOT regexp_matches(text, {quoted(P.QUESTION_START)})))""")
def furniture_lines(spark, sf_dir):
    return pages.without_furniture(S.customer_pages(spark, sf_dir), size=5 * S.table(spark, sf_dir, "orders").count())


CLASS_SQL = f"""CASE WHEN regexp_matches(text, {quoted(P.SECTION)}) AND length(text) <= 90 THEN 'section'
  WHEN regexp_matches(text, {quoted(P.ATTEMPT_START)}) AND regexp_matches(text, {quoted(P.ATTEMPT_SHAPE)}) THEN 'instruction'
  WHEN regexp_matches(text, {quoted(P.BARE_NUMBER)}) THEN 'bare_number'
  WHEN regexp_matches(text, {quoted(P.QUESTION_START)}) THEN 'question' ELSE 'content' END"""


@query(f"WITH {S.SQL_LINES} SELECT paper_id, {CLASS_SQL} AS class, count(*) AS n, count(DISTINCT CASE WHEN {CLASS_SQL} = 'section' THEN substr(text, 9) END) AS labels FROM lines GROUP BY 1, 2")
def line_classes(spark, sf_dir):
    lines = S.order_lines(spark, sf_dir).withColumn("class", line_class(F.col("text")))
    label = F.when(F.col("class") == "section", section_label(F.col("text")))
    return lines.groupBy("paper_id", "class").agg(F.count("*").alias("n"), F.count_distinct(label).alias("labels"))


@query(f"""WITH {S.SQL_PAGES} SELECT paper_id,
  trim(regexp_extract(arg_min(text, page) FILTER (line_no = 2), {quoted(P.SUBJECT)}, 1)) AS subject, arg_min(paper_id, page) AS class, 'CBSE' AS board, '3h' AS time_allowed,
  nullif(regexp_extract(arg_min(text, page) FILTER (line_no = 3), {quoted(P.TOTAL_MARKS)}, 1)::INT, 0) AS total_marks
FROM pages_ GROUP BY paper_id""")
def header_facts(spark, sf_dir):
    return pages.header_facts(S.customer_pages(spark, sf_dir))


@query(f"""WITH {S.SQL_LINES} SELECT paper_id, nullif(sum(regexp_extract(text, 'all ([0-9]+) questions', 1)::INT), 0) AS declared, max(regexp_extract(text, 'carries ([0-9]+) mark', 1)::INT) AS carried
FROM lines WHERE text LIKE 'Attempt%' GROUP BY paper_id""")
def declared_counts(spark, sf_dir):
    t = F.col("text")
    lines = S.order_lines(spark, sf_dir).where(is_instruction(t))
    return lines.groupBy("paper_id").agg(F.nullif(F.sum(declared_count(t)), F.lit(0)).alias("declared"), F.max(carried_marks(t)).alias("carried"))


@query(f"""WITH {S.SQL_QUESTIONS}, firsts AS (
  SELECT paper_id, number, arg_min(section, question_index) AS section FROM questions GROUP BY paper_id, number),
n AS (SELECT paper_id, count(*) AS k, max(number::INT) AS high FROM firsts GROUP BY paper_id),
marks AS (SELECT l_orderkey::VARCHAR AS paper_id, l_linenumber::VARCHAR AS number, arg_min(l_quantity::INT, ({S.SQL_ORDER})) AS marks FROM lineitem GROUP BY 1, 2)
SELECT paper_id, number, section, marks, CASE WHEN k = high THEN 'strict' ELSE 'relaxed' END AS strategy
FROM firsts JOIN n USING (paper_id) JOIN marks USING (paper_id, number)""")
def segment_papers(spark, sf_dir):
    parsed = segment.parsed_papers(S.order_lines(spark, sf_dir), placed=True)
    return parsed.select("paper_id", "strategy", F.explode("questions").alias("q")).select("paper_id", "q.number", "q.section", "q.marks", "strategy")


@query(f"""WITH {S.SQL_QUESTIONS}, {S.SQL_LINES}, firsts AS (
  SELECT paper_id, number, arg_min(section, question_index) AS section, min(question_index) AS place FROM questions GROUP BY paper_id, number),
marks AS (SELECT l_orderkey::VARCHAR AS paper_id, l_linenumber::VARCHAR AS number, arg_min(l_quantity::INT, ({S.SQL_ORDER})) AS marks FROM lineitem GROUP BY 1, 2),
named AS (SELECT paper_id, section, min(place) AS place FROM firsts GROUP BY 1, 2),
heads AS (SELECT paper_id, string_agg(section, ',' ORDER BY place) AS sections FROM named GROUP BY 1),
said AS (SELECT paper_id, sum(regexp_extract(text, 'all ([0-9]+) questions', 1)::INT) AS declared FROM lines WHERE text LIKE 'Attempt%' GROUP BY 1)
SELECT paper_id, 'ready' AS status, count(*)::INT AS total_questions, sum(marks) AS total_marks, any_value(sections) AS sections, any_value(declared)::INT AS declared, 1 AS total_pages
FROM firsts JOIN marks USING (paper_id, number) JOIN heads USING (paper_id) JOIN said USING (paper_id) GROUP BY paper_id""")
def paper_assembly(spark, sf_dir):
    papers = ingest.text_papers(S.order_lines(spark, sf_dir), cut, placed=True).papers
    return papers.select("paper_id", "status", "total_questions", "total_marks", F.array_join("sections", ",").alias("sections"), F.col("declared_question_count").alias("declared"), "total_pages")


@query(f"""SELECT doc_id, CASE WHEN regexp_matches(text, {quoted(P.CASE_STUDY)}) THEN 'long' WHEN n_chars % 9 >= 5 THEN 'long' WHEN regexp_matches(text, {quoted(P.NUMERICAL_HINTS)}) THEN 'numerical' ELSE 'short' END AS type,
  regexp_matches(text, {quoted(P.FIGURE_REF)}) OR regexp_matches(text, {quoted(P.FIGURE_BELOW)}) AS has_figure,
  CASE WHEN regexp_extract(text || ' 7', {quoted("(?s)" + P.TRAILING_MARKS)}, 2) <> '' THEN 7 END AS trailing
FROM documents""")
def type_figure_marks(spark, sf_dir):
    t = F.col("text")
    last = F.element_at(F.split(F.concat(t, F.lit(" 7")), "\n", -1), -1)
    return S.table(spark, sf_dir, "documents").select("doc_id", question_type(t, F.lit(None).cast("array<string>"), (F.col("n_chars") % 9).cast("int")).alias("type"), figure_flag(t).alias("has_figure"), trailing_marks(last).alias("trailing"))


@query(f"""WITH {S.SQL_QUESTIONS}, s AS (SELECT paper_id, section, min(question_index) AS place FROM questions GROUP BY 1, 2)
SELECT paper_id, count(*)::INT AS total_questions, CASE WHEN count(*) = count(marks) THEN sum(marks) END AS total_marks,
  (SELECT string_agg(section, ',' ORDER BY place) FROM s WHERE s.paper_id = q.paper_id) AS sections
FROM questions q GROUP BY paper_id""")
def paper_rollup(spark, sf_dir):
    return pages.paper_rollup(S.order_questions(spark, sf_dir)).withColumn("sections", F.array_join("sections", ","))


REPORT_SQL = f"""{S.SQL_QUESTIONS}, {S.SQL_PAPERS},
nums AS (SELECT paper_id, number, number::INT AS n, min(question_index) AS place FROM questions GROUP BY 1, 2, 3),
falls AS (SELECT *, lag(n) OVER (PARTITION BY paper_id ORDER BY place) AS before FROM nums),
runs AS (SELECT *, lag(section) OVER (PARTITION BY paper_id ORDER BY question_index) AS before FROM questions),
again AS (SELECT *, row_number() OVER (PARTITION BY paper_id, section ORDER BY question_index) AS run FROM runs WHERE before IS NULL OR before <> section),
sums AS (SELECT p.*, count(*) AS n, count(marks) AS known, sum(marks) AS total FROM papers p JOIN questions q USING (paper_id) GROUP BY ALL),
found(paper_id, code, severity, question) AS (
  SELECT paper_id, 'no_questions', 'error', NULL FROM papers WHERE paper_id NOT IN (SELECT paper_id FROM questions)
  UNION ALL SELECT paper_id, 'duplicate_number', 'error', number FROM questions GROUP BY paper_id, number HAVING count(*) > 1
  UNION ALL SELECT paper_id, 'duplicate_text', 'error', {KEY} FROM questions GROUP BY paper_id, {KEY} HAVING count(*) > 1
  UNION ALL SELECT paper_id, 'impossible_ordering', 'error', NULL FROM falls GROUP BY paper_id HAVING bool_or(before > n)
  UNION ALL SELECT paper_id, 'numbering_starts_above_one', 'warning', NULL FROM nums GROUP BY paper_id HAVING min(n) <> 1
  UNION ALL SELECT paper_id, 'numbering_gap', 'warning', NULL FROM nums GROUP BY paper_id HAVING max(n) - min(n) + 1 > count(DISTINCT n)
  UNION ALL SELECT q.paper_id, 'inconsistent_section', 'error', number FROM questions q JOIN papers USING (paper_id) WHERE declares AND section NOT IN ('A', 'N')
  UNION ALL SELECT paper_id, 'section_reappears', 'warning', number FROM again WHERE run > 1
  UNION ALL SELECT paper_id, 'unknown_marks', 'warning', NULL FROM sums WHERE known < n
  UNION ALL SELECT paper_id, 'marks_total_unknown', 'warning', NULL FROM sums WHERE known = 0
  UNION ALL SELECT paper_id, 'marks_total_mismatch', 'warning', NULL FROM sums WHERE known > 0 AND total <> declared_total_marks
  UNION ALL SELECT paper_id, 'question_count_mismatch', 'warning', NULL FROM sums WHERE declared_question_count <> n
  UNION ALL SELECT paper_id, 'total_questions_mismatch', 'error', NULL FROM sums WHERE total_questions <> n)"""


def order_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = S.table(spark, sf_dir, "lineitem").count() + S.table(spark, sf_dir, "orders").count()
    return diagnostics.report(dealt(S.order_papers(spark, sf_dir), "paper_id", size=size), S.order_questions(spark, sf_dir, size))


@query(f"WITH {REPORT_SQL} SELECT paper_id, code, severity, question FROM found")
def quality_report(spark, sf_dir):
    return order_report(spark, sf_dir).select("paper_id", "code", "severity", "question")


@query(f"WITH {REPORT_SQL} SELECT p.paper_id, count(*) FILTER (severity = 'error') AS errors, count(*) FILTER (severity = 'warning') AS warnings, count(*) FILTER (severity = 'error') = 0 AS ok FROM papers p LEFT JOIN found f ON p.paper_id = f.paper_id GROUP BY p.paper_id")
def report_gate(spark, sf_dir):
    return diagnostics.gate(S.order_papers(spark, sf_dir), order_report(spark, sf_dir))


@query(f"""WITH q AS (SELECT conv_id::VARCHAR AS paper_id, turn::VARCHAR AS question, text, turn::INT % 4 AS page, turn * 60 - 60 AS marks, role FROM conversations)
SELECT paper_id, question, code FROM (SELECT paper_id, question, unnest(list_filter([
  CASE WHEN page < 1 THEN 'invalid_page' END, CASE WHEN role = 'assistant' THEN 'invalid_type' END, CASE WHEN marks < 0 OR marks > 100 THEN 'invalid_marks' END,
  CASE WHEN role = 'user' THEN 'empty_options' END, CASE WHEN role = 'user' THEN 'mcq_without_options' END,
  CASE WHEN NOT regexp_matches(text, {quoted(P.FIGURE_REF)}) THEN 'figure_without_reference' END, CASE WHEN length(trim(text)) = 0 THEN 'empty_text' END], lambda x: x IS NOT NULL)) AS code FROM q)""")
def content_rules(spark, sf_dir):
    c = S.table(spark, sf_dir, "conversations")
    user = F.col("role") == "user"
    q = c.select(F.col("conv_id").cast("string").alias("paper_id"), F.col("turn").cast("string").alias("number"), "text", (F.col("turn") % 4).cast("int").alias("page"), (F.col("turn") * 60 - 60).cast("int").alias("marks"), F.when(F.col("role") == "assistant", "other").when(user, "mcq").otherwise("short").alias("type"), F.when(user, F.array().cast("array<string>")).alias("options"), F.lit(True).alias("has_figure"))
    return diagnostics.row_rules(q).select("paper_id", "question", "code")


@query(f"SELECT doc_id, {S.NORM} AS norm, {S.SIGNATURE} AS signature FROM documents")
def signatures(spark, sf_dir):
    return S.table(spark, sf_dir, "documents").select("doc_id", normalize_text(F.col("text")).alias("norm"), question_signature(F.col("text")).alias("signature"))


@query(f"""WITH {S.SQL_SOLVED}, best AS (
  SELECT question_signature, arg_max(id, (confidence, id)) AS id, max(confidence) AS confidence FROM solved
  WHERE NOT needs_teacher_check AND verification_status = 'passed' AND model_used IS NOT NULL GROUP BY 1)
SELECT doc_id, CASE WHEN b.confidence >= 0.9 THEN 'hit' ELSE 'miss' END AS cache_status, CASE WHEN b.confidence >= 0.9 THEN b.id END AS cached_id
FROM (SELECT doc_id, {S.SIGNATURE} AS s FROM documents) d LEFT JOIN best b ON d.s = b.question_signature""")
def signature_lookup(spark, sf_dir):
    items = S.table(spark, sf_dir, "documents").select("doc_id", question_signature(F.col("text")).alias("question_signature"))
    return store.cache_lookup(items, S.solved_store(spark, sf_dir)).select("doc_id", "cache_status", "cached_id")


@query(f"""WITH {S.SQL_SOLVED}, sized AS (SELECT paper_id, count(*) AS n, bool_and(NOT needs_teacher_check AND verification_status = 'passed' AND model_used IS NOT NULL AND confidence >= 0.9) AS sound FROM solved GROUP BY 1)
SELECT p.paper_id, coalesce(sound AND n = n_docs, false) AS hit FROM (SELECT source AS paper_id, count(*) AS n_docs FROM documents GROUP BY 1) p LEFT JOIN sized USING (paper_id)""")
def paper_cache_gate(spark, sf_dir):
    papers = S.table(spark, sf_dir, "documents").groupBy(F.col("source").alias("paper_id")).agg(F.count("*").alias("total_questions")).withColumn("status", F.lit("ready"))
    return store.paper_gate(papers, S.solved_store(spark, sf_dir))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def resume_remaining(spark, sf_dir):
    items = S.table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("paper_id"), F.concat(F.lit("w"), F.col("doc_id").cast("string")).alias("work_item_id"))
    done = S.table(spark, sf_dir, "labels").join(items, "doc_id").select("paper_id", "work_item_id")
    return store.remaining(items, done).select("doc_id")


@query("SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type, max((ts, event_id))[2] AS event_id FROM events GROUP BY user_id")
def upsert_latest(spark, sf_dir):
    return store.latest(S.table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_type", "event_id")


@query("""SELECT c_custkey AS paper_id, CASE WHEN o IS NOT NULL THEN 'ready' ELSE 'parsing' END AS status, CASE WHEN o > 0 AND o % 3 <> 0 THEN o ELSE c_nationkey END AS total_questions
FROM customer LEFT JOIN (SELECT o_custkey, count(*)::INT AS o FROM orders GROUP BY 1) ON o_custkey = c_custkey""")
def paper_upsert(spark, sf_dir):
    papers = S.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("paper_id"), F.lit("parsing").alias("status"), F.col("c_nationkey").alias("total_questions"))
    counts = S.table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("paper_id")).agg(F.count("*").cast("int").alias("n"))
    updates = counts.select("paper_id", F.lit("ready").alias("status"), F.when(F.col("n") % 3 == 0, 0).otherwise(F.col("n")).alias("total_questions"))
    return store.upsert_papers(papers, updates)


@query("SELECT o_orderkey AS paper_id, CASE WHEN o_orderstatus = 'F' THEN 'failed' ELSE 'parsing' END AS status FROM orders")
def status_update(spark, sf_dir):
    o = S.table(spark, sf_dir, "orders")
    papers = o.select(F.col("o_orderkey").alias("paper_id"), F.lit("parsing").alias("status"))
    return store.mark_status(papers, o.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("paper_id"), F.lit("failed").alias("status")))


@query("SELECT l_orderkey AS paper_id, count(*) AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderpriority LIKE '1%') GROUP BY 1")
def cascade_delete(spark, sf_dir):
    o = S.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("paper_id"), "o_orderpriority")
    items = S.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("paper_id"))
    return store.without_papers(o, items, o.where("o_orderpriority like '1%'"))[1].groupBy("paper_id").agg(F.count("*").alias("n"))


def conversation_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = S.table(spark, sf_dir, "conversations")
    return c.select(F.col("conv_id").cast("string").alias("paper_id"), F.col("turn").cast("int").alias("question_index"), F.col("turn").cast("string").alias("number"), "text", F.when(F.col("turn") % 3 != 0, F.col("turn").cast("int")).alias("marks"), (F.col("turn") % 7 == 6).alias("has_figure"))


@query("SELECT conv_id || ':q:' || lpad(turn::VARCHAR, 4, '0') AS work_item_id, turn::INT AS question_index, 2 AS max_attempts FROM conversations")
def work_items(spark, sf_dir):
    return workflow.work_items(conversation_questions(spark, sf_dir)).select("work_item_id", "question_index", "max_attempts")


@query("""SELECT conv_id::VARCHAR AS paper_id, turn::INT AS question_index, json_object('question_number', turn::VARCHAR, 'question_text', coalesce(text, ''), 'marks', CASE WHEN turn % 3 <> 0 THEN turn::INT END,
  'options', NULL, 'has_figure', turn % 7 = 6, 'section', NULL, 'section_title', NULL, 'chapter', NULL, 'figure_interpretation', NULL, 'tool_results', NULL, 'subject', NULL, 'class_name', NULL, 'board', NULL)::VARCHAR AS context FROM conversations""")
def question_contexts(spark, sf_dir):
    questions = conversation_questions(spark, sf_dir)
    return questions.select("paper_id", "question_index", question_context(questions).alias("context"))


@query("SELECT conv_id::VARCHAR AS paper_id, count(*) AS total_questions, count(*) FILTER (trim(text) = '' OR text IS NULL) AS errors, CASE WHEN count(*) FILTER (trim(text) = '' OR text IS NULL) > 0 THEN 'failed' ELSE 'solving' END AS status FROM conversations GROUP BY 1")
def prepared_papers(spark, sf_dir):
    return workflow.prepared(workflow.work_items(conversation_questions(spark, sf_dir)))


HARD = " OR ".join(f"contains(lower(text), '{w}')" for w in P.HARD_WORDS)


@query(f"""SELECT doc_id, CASE WHEN length(text) > 500 OR {HARD} THEN 'hard' ELSE 'moderate' END AS complexity, CASE WHEN length(text) > 500 OR {HARD} THEN 'reasoning' ELSE 'standard' END AS model_tier,
CASE WHEN doc_id % 4 = 0 THEN 'cheap' WHEN doc_id % 4 = 1 THEN 'standard' WHEN doc_id % 4 = 2 THEN 'reasoning' END AS planned_tier FROM documents""")
def plans_and_tiers(spark, sf_dir):
    d = S.table(spark, sf_dir, "documents").withColumn("has_figure", F.lit(False))
    said = F.get(F.array(F.lit("easy"), F.lit("moderate"), F.lit("hard"), F.lit("odd")), (F.col("doc_id") % 4).cast("int"))
    return workflow.fallback_plan(d).select("doc_id", "complexity", "model_tier", workflow.model_tier(said, F.lit("none")).alias("planned_tier"))


def derived_solutions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.table(spark, sf_dir, "lineitem").withColumn("place", F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*S.ORDER)))
    q, n = F.col("l_quantity").cast("int"), F.col("l_linenumber")
    split = F.array(F.struct((q - 5).alias("marks"), F.lit("method").alias("for")), F.struct(n.alias("marks"), F.when(n != 3, "result").alias("for")))
    return rows.select("l_orderkey", "place", F.when(n == 2, " ").otherwise("x").alias("answer"), F.when(n == 4, F.array(F.lit(""))).otherwise(F.array(F.lit("s"))).alias("steps"), split.alias("mark_split"), F.when(n != 5, F.array(F.struct(F.lit("w").alias("wrong"), F.lit("y").alias("why")))).alias("mistakes"), F.when(q % 13 != 0, q).alias("marks"), (F.col("l_linestatus") == "F").alias("review"), (F.col("l_returnflag") == "A").alias("independent"))


DERIVED = f"d AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY {S.SQL_ORDER}) AS place, l_linenumber AS n, l_quantity::INT AS q, CASE WHEN l_quantity::INT % 13 <> 0 THEN l_quantity::INT END AS marks, l_linestatus = 'F' AS review, l_returnflag = 'A' AS independent FROM lineitem)"


@query(f"""WITH {DERIVED} SELECT l_orderkey, place, array_to_string(list_filter([
  CASE WHEN n = 2 THEN 'no answer' END, CASE WHEN n = 4 THEN 'steps missing or blank' END,
  CASE WHEN q - 5 + n > marks THEN 'mark_split adds up to ' || (q - 5 + n) || ' of ' || marks END,
  CASE WHEN n = 5 THEN 'no common_mistakes' END,
  CASE WHEN q < 5 THEN 'mark_split[0] has no marks of 0 or more, or no for' END,
  CASE WHEN n = 3 THEN 'mark_split[1] has no marks of 0 or more, or no for' END], lambda x: x IS NOT NULL), '|') AS errors FROM d""")
def payload_check(spark, sf_dir):
    d = derived_solutions(spark, sf_dir)
    return d.select("l_orderkey", "place", F.array_join(payload_errors(*(F.col(c) for c in ("answer", "steps", "mark_split", "mistakes", "marks"))), "|").alias("errors"))


@query(f"""WITH {DERIVED}, s AS (SELECT *, 25 + CASE WHEN n <> 2 THEN 15 ELSE 0 END + 10 + CASE WHEN q - 5 + n <= marks THEN 10 ELSE 0 END + 10 + CASE WHEN review THEN 20 ELSE 0 END + CASE WHEN independent THEN 10 ELSE 0 END AS h FROM d)
SELECT l_orderkey, place, CASE WHEN review AND independent THEN least(h, 99) ELSE least(h, 59) END / 100.0::DOUBLE AS confidence FROM s""")
def confidence_score(spark, sf_dir):
    d = derived_solutions(spark, sf_dir)
    status = F.when(F.col("review") & F.col("independent"), "passed").otherwise("failed")
    return d.select("l_orderkey", "place", confidence(F.col("answer"), F.col("steps"), F.col("mark_split"), F.col("marks"), F.lit(True), F.col("review"), F.col("independent"), status).alias("confidence"))


@query("""WITH e AS (SELECT event_id, event_type, value, event_id % 5 <> 0 AS has_solution, event_type = 'error' AS broken, value >= 10 AS passed, event_id % 3 AS attempts FROM events),
v AS (SELECT *, CASE WHEN NOT has_solution THEN 'failed' WHEN broken THEN 'needs_review' WHEN passed AND event_type <> 'view' THEN 'passed' ELSE 'failed' END AS status FROM e),
c AS (SELECT *, CASE WHEN NOT has_solution THEN 0 WHEN broken THEN 0.45 WHEN status = 'passed' THEN 0.9 ELSE 0.59 END::DOUBLE AS confidence FROM v)
SELECT event_id, status, confidence, CASE WHEN status = 'passed' OR attempts >= 2 THEN 'finalize' ELSE 'generate' END AS next,
  CASE WHEN status = 'passed' THEN 'completed' WHEN has_solution OR broken THEN 'needs_review' ELSE 'failed' END AS result_status, status <> 'passed' AS needs_teacher_check, status = 'passed' AS store FROM c""")
def verify_and_finalize(spark, sf_dir):
    e = S.table(spark, sf_dir, "events")
    split = F.array().cast("array<struct<marks:int,`for`:string>>")
    rows = e.select("event_id", (F.col("event_id") % 5 != 0).alias("has_solution"), F.when(F.col("event_type") == "error", "timeout").alias("review_error"), F.when(F.col("event_type") == "error", "no vision").alias("generation_error"), (F.col("value") >= 10).alias("passed"), F.lit(0.9).alias("correctness"), F.lit(True).alias("answer_review_passed"), F.lit(True).alias("independent_check_passed"), (F.col("event_type") == "view").alias("needs_vision"), F.lit(False).alias("has_image"), (F.col("event_id") % 3).alias("attempts"), F.lit(2).alias("max_attempts"), F.lit("x").alias("answer"), F.array(F.lit("s")).alias("steps"), split.alias("mark_split"), F.lit(None).cast("int").alias("marks"))
    return workflow.finalized(workflow.route(workflow.verdict(rows))).select("event_id", "status", "confidence", "next", "result_status", "needs_teacher_check", "store")


@query("""WITH f AS (SELECT l_orderkey AS paper_id, count(*) AS total, count(*) FILTER (l_returnflag = 'R') AS failed, count(*) FILTER (l_returnflag = 'A' AND l_linenumber = 7) AS errors FROM lineitem GROUP BY 1)
SELECT o_orderkey AS paper_id, coalesce(total, 0) AS total, coalesce(failed, 0) AS failed, coalesce(errors, 0) AS errors,
  CASE WHEN coalesce(failed, 0) = coalesce(total, 0) THEN 'failed' WHEN failed > 0 OR errors > 0 THEN 'partial' ELSE 'ready' END AS status FROM orders LEFT JOIN f ON o_orderkey = paper_id""")
def paper_status(spark, sf_dir):
    items = S.table(spark, sf_dir, "lineitem").withColumn("paper_id", F.col("l_orderkey"))
    results = items.select("paper_id", F.when(F.col("l_returnflag") == "R", "failed").otherwise("completed").alias("status"))
    errors = items.where("l_returnflag = 'A' and l_linenumber = 7").select("paper_id")
    return workflow.paper_status(S.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("paper_id")), results, errors)


@query("""SELECT user_id::VARCHAR AS paper_id, event_id::VARCHAR AS number, CASE WHEN event_type = 'click' THEN 'mcq' WHEN event_type = 'view' THEN 'long' ELSE 'short' END AS type,
  CASE WHEN value = floor(value) THEN value::INT END AS marks, 'A' AS section, event_id::VARCHAR AS choice_group FROM events WHERE event_type <> 'error'""")
def json_items(spark, sf_dir):
    e = S.table(spark, sf_dir, "events")
    kind = F.when(F.col("event_type") == "click", "mcq").when(F.col("event_type") == "view", "coding").otherwise("essay")
    item = F.struct(F.col("event_id").alias("question_number"), F.concat(F.lit("x OR "), F.col("props")).alias("question_text"), F.col("value").cast("string").alias("marks"), kind.alias("question_type"), F.lit(" section a").alias("section"))
    reply = F.concat(F.lit("```json\n"), F.to_json(F.struct(F.array(item).alias("questions"))), F.lit("\n```"))
    replies = e.select(F.col("user_id").cast("string").alias("paper_id"), F.lit(1).alias("page"), F.when(F.col("event_type") == "error", "no json").otherwise(reply).alias("reply"))
    return vision.canonical(vision.parse_items(replies)).select("paper_id", "number", "type", "marks", "section", "choice_group")


@query(f"SELECT source AS paper_id, 1 AS page, min(doc_id) AS idx, min(n_chars % 7) AS confidence FROM (SELECT *, {KEY} AS k FROM documents) GROUP BY source, k, CASE WHEN k = '' THEN doc_id END")
def text_dedupe(spark, sf_dir):
    d = S.table(spark, sf_dir, "documents")
    items = d.select(F.col("source").alias("paper_id"), F.lit(1).alias("page"), F.col("doc_id").alias("idx"), F.col("lang").alias("number"), "text", F.lit(None).cast("string").alias("marks"), (F.col("n_chars") % 7).alias("confidence"), F.array().cast("array<string>").alias("options"))
    return vision.dedupe_by_text(items).select("paper_id", "page", "idx", "confidence")


@query(r"SELECT source AS paper_id, lang AS number, min(doc_id) AS idx FROM (SELECT *, substr(trim(regexp_replace(text, '\s+', ' ', 'g')), 1, 200) AS k FROM documents) GROUP BY source, lang, k")
def page_dedupe(spark, sf_dir):
    d = S.table(spark, sf_dir, "documents")
    return vision.dedupe_across_pages(d.select(F.col("source").alias("paper_id"), F.col("lang").alias("number"), "text", F.col("doc_id").alias("idx"))).select("paper_id", "number", "idx")


@query("""SELECT o_custkey AS paper_id, arg_min(o_orderstatus, o_orderkey) FILTER (o_orderstatus <> 'O') AS subject, arg_min(o_orderpriority, o_orderkey) AS class FROM orders GROUP BY 1""")
def metadata_merge(spark, sf_dir):
    o = S.table(spark, sf_dir, "orders")
    rows = o.select(F.col("o_custkey").alias("paper_id"), F.col("o_orderkey").alias("page"), F.when(F.col("o_orderstatus") == "O", "").otherwise(F.col("o_orderstatus")).alias("subject"), F.col("o_orderpriority").alias("class"))
    return vision.merge_metadata(rows, ("subject", "class")).withColumn("subject", F.nullif("subject", F.lit("")))


@query("SELECT user_id AS paper_id, event_type AS number, arg_max(value, event_id) AS confidence FROM events WHERE value IS NOT NULL GROUP BY 1, 2")
def confidence_map(spark, sf_dir):
    return vision.confidences(S.table(spark, sf_dir, "events").select(F.col("user_id").alias("paper_id"), F.col("event_type").alias("number"), F.col("value").alias("confidence"), F.col("event_id").alias("idx")))


@query(f"""WITH o AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {S.SQL_ORDER}) AS place FROM lineitem),
f AS (SELECT l_orderkey, l_linenumber, l_returnflag, min(place) AS place, min(l_discount) AS d FROM o GROUP BY 1, 2, 3)
SELECT l_orderkey AS paper_id, l_linenumber::VARCHAR AS number, string_agg('Part ' || l_returnflag, ' ' ORDER BY place) AS text, string_agg('(' || l_returnflag || ') x', ',' ORDER BY place) AS options FROM f GROUP BY 1, 2""")
def tile_merge(spark, sf_dir):
    rows = S.table(spark, sf_dir, "lineitem").withColumn("idx", F.row_number().over(Window.partitionBy("l_orderkey", "l_linenumber").orderBy(*S.ORDER)))
    flag = F.col("l_returnflag")
    items = rows.select(F.col("l_orderkey").alias("paper_id"), F.lit(1).alias("page"), "idx", F.col("l_linenumber").cast("string").alias("number"), F.concat(F.lit("Part "), flag).alias("text"), F.lit(None).cast("string").alias("marks"), F.lit("mcq").alias("kind"), F.array(F.concat(F.lit("("), flag, F.lit(") x"))).alias("options"), F.col("l_discount").alias("confidence"), F.lit(None).cast("string").alias("section"), F.lit(False).alias("has_figure"))
    return vision.merge_tiles(items).select("paper_id", "number", "text", F.array_join("options", ",").alias("options"))


@query("SELECT doc_id, '(A) ' || lang || '|(B) ' || source AS options, regexp_matches(lang, 'en') AS promotable FROM documents")
def option_split(spark, sf_dir):
    d = S.table(spark, sf_dir, "documents")
    line = F.concat(F.lit(" (A) "), F.col("lang"), F.lit("  (B)"), F.col("source"))
    start = F.when(F.col("lang") == "en", "12 Describe the whole of this process").otherwise("110 degrees or so")
    return d.select("doc_id", F.array_join(option_groups(line), "|").alias("options"), promotable(start).alias("promotable"))


@query(f"SELECT l_orderkey, place, q + n * 3 - 7 / n::DOUBLE AS result, (-q) - n * floor((-q)::DOUBLE / n) AS modulo, 'division by zero' AS error FROM ({DERIVED.removeprefix('d AS (').removesuffix(')')})")
def safe_math(spark, sf_dir):
    rows = S.table(spark, sf_dir, "lineitem").withColumn("place", F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*S.ORDER)))
    q, n = F.col("l_quantity").cast("int").cast("string"), F.col("l_linenumber").cast("string")
    said = lambda *parts: safe_calculate(F.concat(*(p if not isinstance(p, str) else F.lit(p) for p in parts)))
    return rows.select("l_orderkey", "place", said(q, " + ", n, " * 3 - 7 / ", n).alias("a"), said("-", q, " % ", n).alias("b"), said(q, " // 0").alias("c")).select("l_orderkey", "place", F.col("a.result").alias("result"), F.col("b.result").alias("modulo"), F.col("c.error").alias("error"))


@query("SELECT conv_id::VARCHAR AS paper_id, turn::INT AS question_index FROM conversations WHERE turn < 3")
def first_questions(spark, sf_dir):
    return store.first_questions(conversation_questions(spark, sf_dir), 3).select("paper_id", "question_index")


@query("""SELECT conv_id || ':q:' || lpad(turn::VARCHAR, 4, '0') AS work_item_id, CASE WHEN blank THEN 'failed' ELSE 'passed' END AS status, CASE WHEN blank THEN 0 WHEN turn % 3 <> 0 THEN 0.99 ELSE 0.9 END::DOUBLE AS confidence,
  CASE WHEN blank OR turn % 5 = 0 THEN 2 ELSE 1 END AS attempts, CASE WHEN blank THEN 'failed' ELSE 'completed' END AS result_status, NOT blank AS store
FROM (SELECT *, trim(coalesce(text, '')) = '' AS blank FROM conversations)""")
def solve_loop(spark, sf_dir):
    done = workflow.solve(workflow.work_items(conversation_questions(spark, sf_dir)), OfflineProvider(), cut)
    return done.select("work_item_id", "status", "confidence", "attempts", "result_status", "store")
