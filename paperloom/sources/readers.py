"""Sources and sinks: texts, binaries, JSON papers and solution books."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.identity import file_fingerprint, paper_id
from ..functions.text import normalise

LEAST_TEXT, LARGEST_UPLOAD, LARGEST_IMAGE = 40, 25 << 20, 20 << 20
IMAGES, IMAGE_SUFFIX = ("png", "jpeg", "webp"), r"(?i)\.(png|jpe?g|webp)$"
IMAGE_NAMES = "*.{png,jpg,jpeg,webp,PNG,JPG,JPEG,WEBP}"
Extract = Callable[[bytes], Iterable[Iterable[str]]]
STATIC_PAPER = "paper_metadata struct<paper_id:string,fingerprint:string,subject:string,class:string,exam:string,total_marks:int,time_allowed:string,board:string>, questions array<struct<number:string,section:string,text:string,marks:int,type:string,options:array<string>,has_figure:boolean,page:int,choice_group:string,chapter:string>>"
BOOK = "paper_id string, fingerprint string, status string, metadata map<string,string>, total_questions int, solutions array<struct<question_number:string,answer:string,steps:array<string>,mark_split:array<struct<marks:int,`for`:string>>,common_mistakes:array<struct<wrong:string,why:string>>,confidence:double,verified_by:string,needs_teacher_check:boolean>>"


def lines_of_texts(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, line_no, text): the lines of a text column that aren't blank."""
    rows = df.select(key, F.posexplode(F.split(text, "\n", -1)).alias("pos", "line"))
    return rows.select(key, (F.col("pos") + 1).alias("line_no"), normalise(F.col("line")).alias("text")).where("text <> ''")


def kind_of(content: Column) -> Column:
    """What a binary is by its first bytes."""
    head = F.hex(F.substring(content, 1, 12))
    return F.when(head.startswith("25504446"), "pdf").when(head.startswith("89504E470D0A1A0A"), "png").when(head.startswith("FFD8FF"), "jpeg").when(head.startswith("52494646") & head.endswith("57454250"), "webp").otherwise("other")


def described(files: DataFrame) -> DataFrame:
    """(path, length, content, fingerprint, paper_id, kind, error) of files (path,
    length, content): a bad file has its error, it doesn't fail the others."""
    kind = kind_of(F.col("content"))
    error = F.when(F.col("length") == 0, "the file is empty").when(F.col("length") > F.when(kind.isin(*IMAGES), LARGEST_IMAGE).otherwise(LARGEST_UPLOAD), "the file is too large").when(kind == "other", "neither PDF nor image")
    print_ = file_fingerprint(F.col("content"))
    return files.select("path", "length", "content", print_.alias("fingerprint"), paper_id(print_).alias("paper_id"), kind.alias("kind"), error.alias("error"))


def binaries(spark: SparkSession, path: str, names: str = "*") -> DataFrame:
    """The files of a folder or pattern, a row each."""
    return described(spark.read.format("binaryFile").option("pathGlobFilter", names).load(path))


def qualified(spark: SparkSession, path: str) -> str:
    """A path as Spark's readers tell it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toString()


def images(spark: SparkSession, path: str) -> DataFrame:
    return binaries(spark, path, IMAGE_NAMES)


def paper_pages(files: DataFrame, extract: Extract) -> DataFrame:
    """(paper_id, page, line_no, text, error) by an extractor of text layers
    (none is installed here, so it is handed in). Too little text is an error."""

    def run(batches):
        for rows in batches:
            out = []
            for pid, content in zip(rows["paper_id"], rows["content"]):
                try:
                    pages = [[t for x in p if (t := x.strip())] for p in extract(content)]
                    if sum(len(x) for p in pages for x in p) < LEAST_TEXT:
                        raise ValueError("the file has no text layer to speak of")
                    out += [(pid, i, k, t, None) for i, p in enumerate(pages, 1) for k, t in enumerate(p, 1)]
                except Exception as e:
                    out.append((pid, None, None, None, str(e)))
            yield pd.DataFrame(out, columns=["paper_id", "page", "line_no", "text", "error"]).astype({"page": "Int32", "line_no": "Int32"})

    return files.where("error is null and kind = 'pdf'").select("paper_id", "content").mapInPandas(run, "paper_id string, page int, line_no int, text string, error string")


def static_papers(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(papers, questions) of a JSON array of papers."""
    raw = spark.read.schema(STATIC_PAPER).json(path, multiLine=True)
    questions = raw.select(F.col("paper_metadata.paper_id").alias("paper_id"), F.posexplode("questions").alias("question_index", "q")).select("paper_id", "question_index", "q.*")
    return raw.select("paper_metadata.*", F.size("questions").alias("total_questions")), questions


def write_books(books: DataFrame, path: str) -> None:
    """One folder of JSON for each paper, so that a read of one prunes the rest."""
    books.write.mode("overwrite").partitionBy("paper_id").json(path)


def read_book(spark: SparkSession, path: str, paper: str) -> DataFrame:
    return spark.read.schema(BOOK).json(path).where(F.col("paper_id") == paper)


def with_overrides(papers: DataFrame, **stated: str | None) -> DataFrame:
    """Metadata that the caller states replaces what was read."""
    return papers.withColumns({k: F.lit(v) for k, v in stated.items() if v}) if any(stated.values()) else papers
