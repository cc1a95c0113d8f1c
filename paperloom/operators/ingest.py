"""From files to validated papers: text layers and page images end to end.

Both ways give the same three tables. What Python reads (a parse, a model's
reply) is cut once, as several rules use it; all else is joins and aggregations
by paper."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable
from functools import reduce
from pathlib import Path
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.identity import paper_id
from ..sources import readers
from ..sources.provider import NoProvider, Provider
from . import diagnostics, pages, segment, tiling, vision

Cut = Callable[[DataFrame], DataFrame]
UNREADABLE = "unreadable"
#: Bytes of an image that go through a fingerprint at a time.
PIECE = 1 << 18


class Ingested(NamedTuple):
    """papers: paper_id, status, subject, class_name, board, total_questions,
    total_marks, sections, total_pages and what the paper declares; questions of
    the canonical shape; diagnostics, errors among them."""

    papers: DataFrame
    questions: DataFrame
    diagnostics: DataFrame

    def raise_if_invalid(self) -> Ingested:
        diagnostics.raise_if_invalid(self.diagnostics)
        return self


def unreadable(rows: DataFrame) -> DataFrame:
    """Errors of rows (paper_id, page, error)."""
    return rows.where("error is not null").select(*diagnostics.finding(UNREADABLE, "error", F.col("error"), F.col("page")))


def assembled(known: DataFrame, questions: DataFrame, facts: DataFrame | None = None) -> DataFrame:
    """Papers of known (paper_id, total_pages, declared_...), with the roll-up of
    their questions and the header's facts (if known doesn't hold them). A paper
    without questions has none, and no marks."""
    rows = known.join(pages.paper_rollup(questions), "paper_id", "left")
    rows = (rows if facts is None else rows.join(facts, "paper_id", "left")).withColumnRenamed("class", "class_name")
    return rows.withColumns({"status": F.lit("ready"), "total_questions": F.coalesce("total_questions", F.lit(0)), "sections": F.coalesce("sections", F.array().cast("array<string>"))})


def text_papers(lines: DataFrame, cut: Cut, placed: bool = False) -> Ingested:
    """lines (paper_id, page, line_no, text): clean pages, parse, assembly and
    report. What the parser put aside are warnings. Lines are dealt by paper once,
    and not at all where they are already (placed)."""
    parsed = cut(segment.parsed_papers(pages.without_furniture(lines, placed=placed), placed=True))
    questions = segment.questions_of(parsed)
    # one pass over the lines for the header's facts and the pages
    facts = pages.header_facts(lines, F.max("page").cast("int").alias("total_pages")).withColumnRenamed("total_marks", "declared_total_marks")
    known = facts.join(parsed.select("paper_id", "strategy", F.col("declared_count").alias("declared_question_count"), F.coalesce("sections", F.array().cast("array<string>")).alias("declared_sections")), "paper_id", "left")
    papers = assembled(known, questions)
    return Ingested(papers, questions, diagnostics.report(papers, questions).unionByName(diagnostics.parser_findings(parsed)))


def reply_papers(replies: DataFrame, cut: Cut) -> Ingested:
    """Papers of models' replies (paper_id, page, reply, and tile where pages were
    read in parts): tiles are folded into their page, repeats on a page and across
    pages go, metadata is the first that a page states. A reply that is none is
    an error of its paper, and takes its page along; a field of another type than
    expected is a finding with its path."""
    parsed = cut(vision.parse_items(replies))
    bad = parsed.where("error is not null").select("paper_id", "page", "error").distinct()
    items = parsed.where("error is null").join(bad.select("paper_id", "page"), ["paper_id", "page"], "left_anti").drop("misfits")
    if "tile" in items.columns:
        items = tiling.folded(items)
    items = cut(vision.dedupe_across_pages(vision.dedupe_by_text(items)))
    place = F.row_number().over(Window.partitionBy("paper_id").orderBy("idx")) - 1
    questions = vision.canonical(items).withColumn("question_index", place)
    none = F.lit(None).cast("int")
    known = replies.groupBy("paper_id").agg(F.max("page").cast("int").alias("total_pages")).withColumns({"declared_total_marks": none, "declared_question_count": none, "declared_sections": F.array().cast("array<string>")})
    papers = assembled(known, questions, vision.merge_metadata(vision.reply_metadata(replies)))
    found = diagnostics.report(papers, questions, "image", vision.confidences(items))
    return Ingested(papers, questions, found.unionByName(vision.schema_findings(parsed)).unionByName(unreadable(bad)))


def image_papers(images: DataFrame, provider: Provider, cut: Cut, concurrency: int = 8, tiler: tiling.Tiler | None = None, **reading) -> Ingested:
    """Papers of page images (paper_id, page, content). Where there is a tiler, a
    page whose reply is cut off is read again in tiles."""
    good, bad = tiling.whole_pages(tiling.read_pages(images, provider, cut, tiler, concurrency, **reading))
    done = reply_papers(good, cut)
    return Ingested(done.papers, done.questions, done.diagnostics.unionByName(unreadable(bad)))


def folded_prints(images: DataFrame, group: str, piece: int = PIECE) -> DataFrame:
    """(group, fingerprint, pages) of images (group, page, content): SHA-256 over a
    group's images in page order, as if their bytes were joined. Images go in
    pieces, sorted, through one running hash, so that a task holds a batch of
    pieces, never a whole group."""
    last = F.floor((F.greatest(F.length("content"), F.lit(1)) - 1) / piece).cast("int")
    rows = images.select(F.col(group).alias("group"), "page", "content", F.explode(F.sequence(F.lit(0), last)).alias("part"))
    rows = rows.select("group", "page", "part", F.substring("content", F.col("part") * piece + 1, F.lit(piece)).alias("bytes"))

    def run(batches):
        now, state, pages, seen = None, None, 0, None
        for b in batches:
            out = []
            for group_, page, part, content in zip(b["group"], b["page"], b["part"], b["bytes"]):
                if state is None or group_ != now:
                    if state is not None:
                        out.append((now, state.hexdigest(), pages))
                    now, state, pages, seen = group_, hashlib.sha256(), 0, None
                state.update(content)
                if (page, part) != seen and part == 0:
                    pages += 1
                seen = (page, part)
            if out:
                yield pd.DataFrame(out, columns=["group", "fingerprint", "pages"])
        if state is not None:
            yield pd.DataFrame([(now, state.hexdigest(), pages)], columns=["group", "fingerprint", "pages"])

    kind = images.schema[group].dataType.simpleString()
    ordered = rows.repartition("group").sortWithinPartitions("group", "page", "part")
    return ordered.mapInPandas(run, f"`group` {kind}, fingerprint string, pages long").withColumnRenamed("group", group)


def merged_ingests(*done: Ingested) -> Ingested:
    """The tables of several ways, as one."""
    return Ingested(*(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables) for tables in zip(*done)))


def routed(files: DataFrame, extract: readers.Extract, provider: Provider, cut: Cut, tiler: tiling.Tiler | None = None, concurrency: int = 8, stated: dict[str, str | None] | None = None, **reading) -> Ingested:
    """Papers of files (path, content, fingerprint, kind, error, as
    readers.described gives them), each by its way: PDFs by their text layer,
    images by a model, a paper each. Every file is a paper or has an error; one
    that can't be read fails no other. Files of equal content are one paper.

    Papers are told apart by their whole fingerprint; paper_id is its short form."""
    files = files.groupBy("fingerprint").agg(F.min_by(F.struct("path", "content", "kind", "error"), "path").alias("f")).select(F.col("fingerprint").alias("paper_id"), "f.*")
    files = cut(files)
    lines = cut(readers.paper_pages(files, extract))
    texts = text_papers(lines.where("error is null").drop("error"), cut)
    pictures = files.where("error is null").where(F.col("kind").isin(*readers.IMAGES)).select("paper_id", F.lit(1).alias("page"), "content")
    seen = image_papers(pictures, provider, cut, concurrency, tiler, **reading)
    none = F.lit(None).cast("int").alias("page")
    bad = files.where("error is not null").select("paper_id", none, "error").unionByName(lines.select("paper_id", "page", "error"))
    both = merged_ingests(texts, seen)
    return named(Ingested(readers.with_overrides(both.papers, **(stated or {})), both.questions, both.diagnostics.unionByName(unreadable(bad))))


def named(done: Ingested) -> Ingested:
    """Tables whose paper_id is a fingerprint get it as a column, and the short id."""

    def short(df: DataFrame) -> DataFrame:
        rest = [c for c in df.columns if c not in ("paper_id", "fingerprint")]
        return df.select(paper_id(F.col("paper_id")).alias("paper_id"), F.col("paper_id").alias("fingerprint"), *rest)

    return Ingested(*map(short, done))


def file_papers(spark: SparkSession, path: str, extract: readers.Extract, cut: Cut, provider: Provider | None = None, tiler: tiling.Tiler | None = None, **stated: str | None) -> Ingested:
    """Papers of a folder, a pattern or a file; what the caller states (subject,
    class_name, board) replaces what was read. Without a provider an image is an
    error of its paper."""
    return routed(readers.binaries(spark, path), extract, provider or NoProvider(), cut, tiler, stated=stated)


def image_list_paper(spark: SparkSession, paths: list[str], provider: Provider, cut: Cut, tiler: tiling.Tiler | None = None, **stated: str | None) -> Ingested:
    """One paper of several images, its pages in the order of the list."""
    if not paths:
        raise ValueError("the list of images is empty")
    odd = [p for p in paths if not re.search(readers.IMAGE_SUFFIX, p)]
    if odd:
        raise ValueError(f"not an image by its name: {odd[0]}")
    # a row for each path of the list
    places = spark.createDataFrame([(readers.qualified(spark, p), k) for k, p in enumerate(paths, 1)], "path string, page int")
    files = readers.described(spark.read.format("binaryFile").load(list(dict.fromkeys(paths)))).select("path", "content", "error")
    pages = cut(files.join(F.broadcast(places), "path").withColumn("list", F.lit(0)))
    fingerprint = folded_prints(pages, "list").first()["fingerprint"]  # of the one list
    rows = pages.withColumn("paper_id", F.lit(fingerprint))
    seen = image_papers(rows.where("error is null").select("paper_id", "page", "content"), provider, cut, tiler=tiler)
    bad = unreadable(rows.select("paper_id", "page", "error"))
    return named(Ingested(readers.with_overrides(seen.papers, **stated), seen.questions, seen.diagnostics.unionByName(bad)))


def ingest(spark: SparkSession, source: str | Path | bytes | list, extract: readers.Extract, provider: Provider, cut: Cut, tiler: tiling.Tiler | None = None, **stated: str | None) -> Ingested:
    """Papers of a path (a file, folder or pattern), of a file's bytes, or of a
    list of images that are the pages of one paper."""
    if isinstance(source, list):
        return image_list_paper(spark, [str(p) for p in source], provider, cut, tiler, **stated)
    if isinstance(source, bytes):
        if not source:
            raise ValueError("the file is empty")
        files = spark.createDataFrame([("bytes", len(source), source)], "path string, length long, content binary")
        return routed(readers.described(files), extract, provider, cut, tiler, stated=stated)
    if isinstance(source, (str, Path)):
        return file_papers(spark, str(source), extract, cut, provider, tiler, **stated)
    raise ValueError(f"no way to read a {type(source).__name__}")


def summary(done: Ingested) -> DataFrame:
    """(paper_id, questions, marks, sections, errors, warnings, ok), a row for each
    paper and each file that gave none."""
    counts = done.diagnostics.groupBy("paper_id").agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"))
    rows = done.papers.select("paper_id", F.col("total_questions").alias("questions"), F.col("total_marks").alias("marks"), "sections").join(counts, "paper_id", "full_outer")
    rows = rows.fillna(0, ["questions", "errors", "warnings"])
    return rows.withColumn("ok", F.col("errors") == 0)


def question_dicts(done: Ingested, paper_id: str) -> list[dict]:
    """The questions of one paper, in order, as dicts."""
    return [r.asDict(recursive=True) for r in done.questions.where(F.col("paper_id") == paper_id).orderBy("question_index").collect()]
