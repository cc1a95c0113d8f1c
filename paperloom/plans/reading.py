"""Queries of what is read: calls and their outcomes, tiles, shapes, files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import shapes as H
from ..functions.text import line_class
from ..operators import ingest, pages, tiling, vision
from ..operators.dealing import dealt
from ..sources import readers
from ..sources.calls import Reply
from ..sources.provider import LineReader, OfflineProvider
from . import shapes as S
from .registry import cut, query

KEY = "substr(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9]+', '', 'g'), 1, 160)"
MOST_LINES, LEAST_LINES = 4, 6


class EventReader(OfflineProvider):
    """Replies and failures by what an image says, each kind of outcome once."""

    def read_image(self, image: bytes, page: int):
        said = image.decode()
        if said.startswith("error"):
            raise RuntimeError("429: tokens per day are used up" if page % 2 else "503, the model is busy")
        if said.startswith("view"):
            return Reply('{"questions": [', "length" if page % 2 else "content_filter")
        return Reply("" if said.startswith("purchase") and page % 2 else '{"questions": []}', "stop")


@query("""SELECT event_id, CASE WHEN event_type = 'error' THEN CASE WHEN event_id % 2 = 0 THEN 'quota' ELSE 'transport' END
  WHEN event_type = 'view' THEN CASE WHEN event_id % 2 = 0 THEN 'truncated' ELSE 'other' END
  WHEN event_type = 'purchase' AND event_id % 2 = 0 THEN 'other' ELSE 'finished' END AS outcome, CASE WHEN event_type = 'error' AND event_id % 2 = 1 THEN 2 ELSE 1 END AS calls FROM events""")
def call_outcomes(spark, sf_dir):
    """An event is a page image (S13, S14): its call's outcome, and how often it was made."""
    e = S.table(spark, sf_dir, "events")
    images = e.select(F.col("event_id").cast("string").alias("paper_id"), (F.col("event_id") + 1).cast("int").alias("page"), F.encode("event_type", "UTF-8").alias("content"))
    reads = tiling.read_pages(images, EventReader(), cut, pause=0.0)
    return reads.select(F.col("paper_id").cast("long").alias("event_id"), "outcome", "calls")


def numbered_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as page images that are texts: a line is a question of its number."""
    d = S.table(spark, sf_dir, "documents")
    lines = F.transform(F.split("text", "\n", -1), lambda x, k: F.concat((k + 1).cast("string"), F.lit("\t"), x))
    return d.select(F.col("doc_id").cast("string").alias("paper_id"), F.lit(1).alias("page"), F.encode(F.array_join(lines, "\n"), "UTF-8").alias("content"))


def tiles_sql(n: str) -> str:
    return f"({n} // 2 + floor({n} * 0.25)::INT)", f"({n} - greatest({n} // 2 - floor({n} * 0.25)::INT, 0))"


A, B = tiles_sql("n")
AA, AB = tiles_sql("a")
BA, BB = tiles_sql("b")
LOST = f"> {MOST_LINES}"


@query(f"""WITH d AS (SELECT doc_id, len(string_split(text, chr(10))) AS n FROM documents),
halves AS (SELECT *, {A} AS a, {B} AS b FROM d),
quarters AS (SELECT *, {AA} AS aa, {AB} AS ab, {BA} AS ba, {BB} AS bb FROM halves),
reads AS (SELECT *, n {LOST} AND n >= {LEAST_LINES} AS cut, n {LOST} AND n >= {LEAST_LINES} AND a {LOST} AND a >= {LEAST_LINES} AS cut_a, n {LOST} AND n >= {LEAST_LINES} AND b {LOST} AND b >= {LEAST_LINES} AS cut_b FROM quarters),
fates AS (SELECT doc_id, CASE WHEN NOT cut THEN 1 ELSE 2 + cut_a::INT + cut_b::INT END AS tiles,
  CASE WHEN NOT cut THEN n {LOST} ELSE CASE WHEN cut_a THEN aa {LOST} OR ab {LOST} ELSE a {LOST} END OR CASE WHEN cut_b THEN ba {LOST} OR bb {LOST} ELSE b {LOST} END END AS lost FROM reads),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text FROM documents),
k AS (SELECT doc_id, {KEY} AS key FROM l),
items AS (SELECT doc_id, count(DISTINCT key) FILTER (key <> '') + count(*) FILTER (key = '') AS items FROM k GROUP BY doc_id)
SELECT doc_id, tiles, CASE WHEN lost THEN 0 ELSE items END AS items, lost FROM fates JOIN items USING (doc_id)""")
def tiled_pages(spark, sf_dir):
    """Documents read by a model whose replies end after four lines (M7): the
    tiles that each was read in, and the items that they were folded to."""
    reads = tiling.read_pages(numbered_pages(spark, sf_dir), LineReader(MOST_LINES), cut, tiling.LineTiler(), least_height=LEAST_LINES)
    good, bad = tiling.whole_pages(reads)
    items = vision.dedupe_by_text(tiling.folded(cut(vision.parse_items(good)).drop("misfits")))
    tiles = reads.groupBy("paper_id").agg(F.count("*").alias("tiles"))
    found = items.groupBy("paper_id").agg(F.count("*").alias("items"))
    rows = tiles.join(found, "paper_id", "left").join(bad.select("paper_id", F.lit(True).alias("lost")), "paper_id", "left")
    return rows.select(F.col("paper_id").cast("long").alias("doc_id"), "tiles", F.coalesce("items", F.lit(0)).alias("items"), F.coalesce("lost", F.lit(False)).alias("lost"))


@query("""WITH c AS (SELECT conv_id::VARCHAR AS paper_id, turn::INT + 1 AS page, turn::INT AS t, text FROM conversations WHERE text IS NOT NULL),
f AS (SELECT paper_id, page, t, unnest([
  CASE WHEN t % 2 = 1 THEN {'m': '.question_text: expected string or null, found number', 's': 'error'} END,
  CASE WHEN t % 3 = 1 THEN {'m': '.options: expected array or null, found string', 's': 'error'} END,
  CASE WHEN t % 3 = 2 THEN {'m': '.options[1]: expected string, found number', 's': 'error'} END,
  CASE WHEN t % 4 = 1 THEN {'m': '.marks: expected number or string or null, found boolean', 's': 'warning'} END,
  CASE WHEN t % 5 = 1 THEN {'m': '.has_figure: expected boolean or null, found string', 's': 'warning'} END,
  CASE WHEN t % 5 = 2 THEN {'m': '.confidence: expected number or null, found object', 's': 'warning'} END]) AS x FROM c)
SELECT paper_id, page, t::VARCHAR AS question, 'questions[0]' || x.m AS message, x.s AS severity FROM f WHERE x IS NOT NULL""")
def schema_findings(spark, sf_dir):
    """A turn is a page's reply (V2, M3), with fields of wrong types by its number."""
    c = S.table(spark, sf_dir, "conversations").where("text is not null")
    t = F.col("turn").cast("int")
    field = lambda name, value: F.concat(F.lit(f', "{name}": '), value)
    text = F.when(t % 2 == 1, t.cast("string")).otherwise(F.to_json(F.array("text")).substr(F.lit(2), F.length(F.to_json(F.array("text"))) - 2))
    options = F.when(t % 3 == 1, '"(A) x"').when(t % 3 == 2, '["(A) x", 5]').otherwise('["(A) x"]')
    marks, figure = F.when(t % 4 == 1, "true").otherwise('"3"'), F.when(t % 5 == 1, '"no"').otherwise("null")
    sure = F.when(t % 5 == 2, '{"of": 1}').otherwise("0.5")
    reply = F.concat(F.lit('{"questions": [{"question_number": '), t.cast("string"), field("question_text", text), field("options", options), field("marks", marks), field("has_figure", figure), field("confidence", sure), F.lit("}]}"))
    replies = c.select(F.col("conv_id").cast("string").alias("paper_id"), (t + 1).alias("page"), reply.alias("reply"))
    return vision.schema_findings(cut(vision.parse_items(replies))).select("paper_id", "page", "question", "message", "severity")


@query("""SELECT event_id, CASE json_type(props, '$.k') WHEN 'UBIGINT' THEN 'number' WHEN 'BIGINT' THEN 'number' WHEN 'DOUBLE' THEN 'number' WHEN 'VARCHAR' THEN 'string' WHEN 'NULL' THEN 'null' WHEN 'BOOLEAN' THEN 'boolean' ELSE lower(json_type(props, '$.k')) END AS kind,
  coalesce(json_extract_string(props, '$.k') NOT IN ('0', '', 'false'), false) AS truth FROM events""")
def field_kinds(spark, sf_dir):
    v = H.member(F.try_parse_json("props"), "k")
    return S.table(spark, sf_dir, "events").select("event_id", H.kind_of(v).alias("kind"), H.truthy(v).alias("truth"))


@query("""WITH r AS (SELECT user_id AS page, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS y, CASE WHEN event_type = 'view' THEN 0 ELSE value END AS darkness, count(*) OVER (PARTITION BY user_id) AS h FROM events WHERE value IS NOT NULL),
band AS (SELECT *, h // 2 AS mid FROM r WHERE y BETWEEN greatest(0, h // 2 - 20) AND least(h - 1, h // 2 + 20)),
lit AS (SELECT *, greatest(avg(darkness) OVER (PARTITION BY page) * 0.25, 1.0) AS threshold FROM band)
SELECT page, any_value(h)::INT AS height, arg_min(y, (darkness > threshold, abs(y - mid), -y))::INT AS split FROM lit GROUP BY page""")
def split_rows(spark, sf_dir):
    """A user's events as the rows of a page (M6): where to cut it."""
    from pyspark.sql import Window

    e = S.table(spark, sf_dir, "events").where("value is not null")
    y = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    raster = e.select(F.col("user_id").alias("page"), y.alias("y"), F.when(F.col("event_type") == "view", 0.0).otherwise(F.col("value")).alias("darkness"))
    return tiling.split_rows(raster, radius=20)


@query("SELECT source AS paper_id, sha256(string_agg(coalesce(text, ''), '' ORDER BY doc_id)) AS fingerprint, count(*) AS pages FROM documents GROUP BY source")
def image_fingerprints(spark, sf_dir):
    """A source's documents as the page images of a paper (M15): one identity over
    all their bytes, in page order."""
    d = S.table(spark, sf_dir, "documents")
    images = d.select(F.col("source").alias("paper_id"), F.col("doc_id").alias("page"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("content"))
    return ingest.folded_prints(images, "paper_id", piece=1000)


def text_layer(content: bytes) -> list[list[str]]:
    return [content.decode().split("\n")[1:]]


@query("""WITH f AS (SELECT doc_id, doc_id % 5 AS way, n_chars, len(string_split(text, chr(10))) AS lines, row_number() OVER (PARTITION BY CASE WHEN doc_id % 5 = 3 THEN -1 ELSE doc_id END ORDER BY doc_id) AS nth FROM documents)
SELECT doc_id, CASE way WHEN 0 THEN 'pdf' WHEN 1 THEN 'png' ELSE NULL END AS read_as,
  CASE way WHEN 0 THEN 2 WHEN 1 THEN 1 END AS questions, CASE way WHEN 2 THEN 'neither PDF nor image' WHEN 3 THEN 'the file is empty' WHEN 4 THEN 'the file has no text layer to speak of' END AS error
FROM f WHERE nth = 1""")
def routed_files(spark, sf_dir):
    """Documents as files (S5-S7): texts with two questions, images of one line,
    others that can't be read, empty ones (all one file), texts without a layer."""
    d = S.table(spark, sf_dir, "documents").where("text is not null")
    way, one = F.col("doc_id") % 5, F.col("doc_id").cast("string")
    ask = F.concat(F.lit("%PDF-1\n1 What is the whole length of text number "), one, F.lit("?\n2 Why is that so, and for how long was it?"))
    png = F.concat(F.unhex(F.lit("89504E470D0A1A0A")), F.encode(F.concat(F.lit("1\tWhat is in picture "), one, F.lit("?")), "UTF-8"))
    content = F.when(way == 0, F.encode(ask, "UTF-8")).when(way == 1, png).when(way == 2, F.encode(F.concat(F.lit("GIF89a"), one), "UTF-8")).when(way == 3, F.encode(F.lit(""), "UTF-8")).otherwise(F.encode(F.concat(F.lit("%PDF-1\n"), one), "UTF-8"))
    files = readers.described(d.select(F.format_string("%012d", "doc_id").alias("path"), F.length(content).cast("long").alias("length"), content.alias("content")))
    done = ingest.routed(files, text_layer, PngReader(), cut)
    first = files.groupBy("fingerprint").agg(F.min("path").alias("path"), F.first("kind").alias("kind"))
    errors = done.diagnostics.where(F.col("code") == ingest.UNREADABLE).select("fingerprint", F.col("message").alias("error"))
    rows = first.join(done.papers.select("fingerprint", F.col("total_questions").alias("questions")), "fingerprint", "left").join(errors, "fingerprint", "left")
    return rows.select(F.col("path").cast("long").alias("doc_id"), F.when(F.col("questions").isNotNull(), F.col("kind")).alias("read_as"), "questions", "error")


class PngReader(LineReader):
    """Reads lines after the eight bytes that make a file a PNG."""

    def read_image(self, image: bytes, page: int):
        return super().read_image(image[8:], page)


#: A line of each class, and the class that it must have; no pattern is shared with the code.
CLASSED = [
    ("Page 3 of 9", "furniture"), ("Q.NO. Questions", "furniture"), ("[Ch 4: Sets]", "chapter"), ("Section B: Grammar", "section"), ("Attempt any 3 questions", "instruction"), ("OR", "or"), ("12", "bare_number"), ("General Instructions", "instructions_heading"),
    ("7. Why is that so?", "question"), ("Some plain words.", "content"), ("Section of a text that goes on", "content"), ("Q4) How was it?", "question"), ("or", "or"), ("Part IV", "section"), ("Answer the following in brief.", "content"), ("Answer 3 out of 5", "instruction"),
]


@query("SELECT l_orderkey AS paper_id, l_linenumber AS line_no, [" + ", ".join(f"'{c}'" for _, c in CLASSED) + f"][(l_orderkey + l_linenumber * 3 + l_partkey) % {len(CLASSED)} + 1] AS class, count(*) AS n FROM lineitem GROUP BY 1, 2, 3")
def class_branches(spark, sf_dir):
    """Lines of each class (T3 to T8, T11), by number."""
    k = ((F.col("l_orderkey") + F.col("l_linenumber") * 3 + F.col("l_partkey")) % len(CLASSED)).cast("int")
    lines = S.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("paper_id"), F.col("l_linenumber").alias("line_no"), F.get(F.array(*(F.lit(t) for t, _ in CLASSED)), k).alias("text"))
    return lines.groupBy("paper_id", "line_no", line_class(F.col("text")).alias("class")).agg(F.count("*").alias("n"))


@query("""WITH p AS (SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS page, count(*) OVER (PARTITION BY o_custkey) AS pages FROM orders),
l AS (SELECT *, unnest(range(1, 10)) AS line_no FROM p)
SELECT o_custkey::VARCHAR AS paper_id, page, line_no FROM l
WHERE pages < 2 OR line_no BETWEEN 4 AND 8 OR line_no = 3 AND (page % 2 = 0 OR (pages + 1) // 2 < greatest(2, ceil(pages * 0.6)))""")
def furniture_branches(spark, sf_dir):
    """Pages of nine lines (T1, T4): a running head, a column head, a line on odd
    pages only, a long line, two lines in the middle, a sentence, a bare number and
    a footer, the same on all pages."""
    from pyspark.sql import Window

    o = S.table(spark, sf_dir, "orders")
    size, o = o.count(), dealt(o, "o_custkey")
    w = Window.partitionBy("o_custkey")
    rows = o.select(F.col("o_custkey").cast("string").alias("paper_id"), F.row_number().over(w.orderBy("o_orderkey")).alias("page"), F.count("*").over(w).alias("pages"))
    page = F.col("page").cast("string")
    said = F.array(
        F.concat(F.lit("Running head "), F.col("paper_id")), F.lit("Q.NO. Questions"), F.when(F.col("page") % 2 == 1, "Odd words").otherwise(F.concat(F.lit("Even words "), page)),
        F.lit("A line that is the same on every page but much too long for a running head of any paper"), F.lit("Middle words"), F.lit("Other middle words"), F.lit("Answer in ink."), F.lit("7"), F.concat(F.lit("Page "), page, F.lit("/"), F.col("pages").cast("string")),
    )
    lines = rows.select("paper_id", "page", F.posexplode(said).alias("pos", "text")).select("paper_id", "page", (F.col("pos") + 1).alias("line_no"), "text")
    return pages.without_furniture(lines, size=9 * size).select("paper_id", "page", "line_no")
