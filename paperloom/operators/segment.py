"""Lines to numbered questions.

Which number is accepted depends on all that were accepted before, so a paper
is read in order: lines are dealt by paper and sorted, and mapInArrow holds one
paper at a time. All that doesn't need order (classes, header facts, roll-ups) is
done in columns elsewhere. A paper is read strictly first (1, 2, 3, ...); only
if that leaves a rejected line worth it, it is read again, relaxed (any larger
unseen number, but only after a finished line), and the second reading is used
if it has more questions, all with different numbers.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from .dealing import dealt

RX = {k: re.compile(v) for k, v in vars(P).items() if k.isupper() and isinstance(v, str)}
SPLIT_OPTIONS = re.compile(P.OPTION_MARK)
ENDED = re.compile(r"[.?!…।:]\s*$")
ENDS = (".", "?", "!", "…", "।", ":")  # of lines without white space at the end
#: How any line starts that is a heading, an instruction, furniture or a chapter's tag.
OPENING = re.compile(r"(?i)^\s*(?:Section|Part|Unit|Attempt|Answer|General|Instruction|Note|Q\s*\.?\s*N|Page|\[Ch)")
#: What a text that names a figure holds.
FIGURES = re.compile("fig|diagram|graph|plot|sketch")
QUESTION = "paper_id string, question_index int, number string, section string, section_title string, text string, marks int, type string, options array<string>, has_figure boolean, page int, choice_group string, chapter string"
PARSED = "paper_id string, strategy string, declared_count int, sections array<string>, rejected array<string>, questions array<struct<question_index:int,number:string,section:string,section_title:string,text:string,marks:int,type:string,options:array<string>,has_figure:boolean,page:int,choice_group:string,chapter:string>>"


ROW = pa.struct([("question_index", pa.int32()), ("number", pa.string()), ("section", pa.string()), ("section_title", pa.string()), ("text", pa.string()), ("marks", pa.int32()), ("type", pa.string()), ("options", pa.list_(pa.string())), ("has_figure", pa.bool_()), ("page", pa.int32()), ("choice_group", pa.string()), ("chapter", pa.string())])
ROWS = pa.schema([("paper_id", pa.string()), ("strategy", pa.string()), ("declared_count", pa.int32()), ("sections", pa.list_(pa.string())), ("rejected", pa.list_(pa.string())), ("questions", pa.list_(ROW))])


def clean(text: str | None) -> str:
    return (text or "").replace("\u00a0", " ").strip()


@dataclass
class Block:
    number: str
    page: int
    section: str | None
    title: str | None
    section_marks: int | None
    lines: list[str]
    chapters: list[str] = field(default_factory=list)


@dataclass
class Reading:
    blocks: list[Block] = field(default_factory=list)
    declared: int = 0
    sections: list[str] = field(default_factory=list)
    rejected: list[str] = field(default_factory=list)


class Told(NamedTuple):
    """What a line says by itself. start: a question's number, the mark after it
    and the text; head: a section's label and title."""

    line: str
    start: tuple[int, str | None, str] | None = None
    head: tuple[str, str | None] | None = None
    heads_instructions: bool = False
    attempts: bool = False
    declared: int = 0
    carried: int | None = None
    furniture: bool = False
    chapter: bool = False


def told(raw: str | None) -> Told:
    line = clean(raw)
    m = RX["QUESTION_START"].match(line)
    start = (int(m[1]), m[2], m[3]) if m else None
    if not OPENING.match(line):
        return Told(line, start)
    m = RX["SECTION"].match(line) if len(line) <= P.MAX_HEADING else None
    head = (m[1], m[2]) if m else None
    attempts = bool(RX["ATTEMPT_START"].search(line) and RX["ATTEMPT_SHAPE"].search(line))
    declared = carried = None
    if attempts:
        declared = RX["DECLARED_ALL"].search(line) or RX["DECLARED_PICK"].search(line)
        carried = RX["CARRIED_MARKS"].search(line)
    return Told(line, start, head, bool(RX["INSTRUCTIONS_HEADING"].match(line)), attempts, int(declared[1]) if declared else 0, int(carried[1]) if carried else None, bool(RX["QNO_HEADER"].match(line) or RX["PAGE_FOOTER"].match(line)), bool(RX["CHAPTER_TAG"].match(line)))


#: Headings, instructions and marks repeat from paper to paper: a worker keeps what its latest short lines say.
told_before = lru_cache(1 << 14)(told)


def known(raw: str | None) -> Told:
    return told_before(raw) if raw is None or len(raw) <= P.MAX_HEADING else told(raw)


def read(lines: list[tuple[int, Told]], relaxed: bool) -> Reading:
    """One pass; each line is settled by the first of these that knows it."""
    out = Reading()
    block: Block | None = None
    section = title = marks = None
    expected, last, seen, instructing = 1, 0, set(), False
    for page, (line, start, head, heads_instructions, attempts, declared, carried, furniture, chapter) in lines:
        if head:
            block, instructing = None, False
            (section, title), marks = head, None
            if section not in out.sections:
                out.sections.append(section)
            continue
        if heads_instructions and block is None:
            instructing = True
            continue
        if attempts:
            instructing = False
            out.declared += declared
            marks = marks if carried is None else carried
            continue
        if furniture:
            continue
        if instructing:
            if not start or start[1]:
                continue
            instructing = False
        if chapter:
            if block and not any(line in x for x in block.chapters):
                block.chapters.append(line)
            continue
        if start:
            n = start[0]
            fits = n == expected or (relaxed and (not seen or (n > last and n not in seen)))
            if fits and relaxed and block and block.lines:
                before = block.lines[-1]
                fits = bool(before.endswith(ENDS) or RX["CHAPTER_TAG"].match(before) or RX["BARE_NUMBER"].match(before) or SPLIT_OPTIONS.search(before))
            if fits:
                block = Block(str(n), page, section, title, marks, [start[2]])
                out.blocks.append(block)
                expected, last = n + 1, n
                seen.add(n)
                continue
            out.rejected.append(line[:120])
        if block:
            block.lines.append(line)
    return out


def worth_retrying(line: str) -> bool:
    m = RX["QUESTION_START"].match(clean(line))
    if not m or RX["BARE_NUMBER"].match(line):
        return False
    body = m[3]
    return bool(re.search("[A-Za-z]{3,}", body) and not RX["UNIT_LEAD"].match(body) and (len(body) >= 25 or re.search(r"[A-Za-z]{3,}\s+\S+\s+\S", body)))


def choose(lines: list[tuple[int, str]]) -> tuple[str, Reading]:
    """The rejected lines reported are those of the reading that is used."""
    said = [(page, x) for page, raw in lines if (x := known(raw)).line]  # once for both readings
    strict = read(said, False)
    if any(map(worth_retrying, strict.rejected)):
        loose = read(said, True)
        numbers = [b.number for b in loose.blocks]
        if len(loose.blocks) > len(strict.blocks) and len(set(numbers)) == len(numbers):
            loose.declared, loose.sections = strict.declared, strict.sections
            return "relaxed", loose
    return "strict", strict


def take_marks(stem: str, body: list[str], section_marks: int | None) -> tuple[int | None, str, list[str]]:
    """A bare number line, else a number after the end of the stem or of the
    last line, else what the section says each carries. What is used goes from
    the text."""
    for k, line in enumerate(body):
        m = RX["PLAIN_NUMBER"].match(line)
        if m and 1 <= int(m[1]) <= P.MAX_MARKS:
            return int(m[1]), stem, body[:k] + body[k + 1 :]
    m = RX["TRAILING_MARKS"].match(stem)
    if m and 1 <= int(m[2]) <= P.MAX_MARKS:
        return int(m[2]), m[1].rstrip(), body
    m = RX["TRAILING_MARKS"].match(body[-1]) if body else None
    if m and 1 <= int(m[2]) <= P.MAX_MARKS:
        return int(m[2]), stem, [*body[:-1], m[1].rstrip()]
    return section_marks, stem, body


def options_in(line: str) -> list[str]:
    line = clean(line)
    marks = list(SPLIT_OPTIONS.finditer(line)) if line.startswith("(") else []
    ends = [m.start() for m in marks[1:]] + [len(line)]
    return [f"({m[1]}) {line[m.end() : e].strip()}".rstrip() for m, e in zip(marks, ends)]


def boundary(line: str) -> bool:
    return any(RX[k].match(clean(line)) for k in ("OR_SEPARATOR", "BARE_NUMBER", "CHAPTER_TAG", "QUESTION_START", "SUBPART"))


def take_options(body: list[str]) -> tuple[list[str], list[str]]:
    """The run of options that starts at (A) before any sub-part, and the lines
    around it. A line without a label joins an option that was cut off."""
    if not body:
        return [], body
    scan = body[: P.MAX_OPTION_SCAN]
    begin = next((k for k, x in enumerate(scan) if (o := options_in(x)) and o[0].startswith("(A)") or boundary(x)), None)
    if begin is None or not (found := options_in(scan[begin])) or not found[0].startswith("(A)"):
        return [], body
    end = begin + 1
    for line in scan[begin + 1 :]:
        more = options_in(line)
        if more:
            if more[0][1] != chr(ord(found[-1][1]) + 1):
                break
            found += more
        elif boundary(line) or ENDED.search(found[-1]):
            break
        else:
            found[-1] = f"{found[-1]} {clean(line)}".strip()
        end += 1
    return found, body[:begin] + body[end:]


def names_figure(text: str) -> bool:
    if text.isascii() and not FIGURES.search(text.lower()):  # else other letters may stand for these
        return False
    return bool(RX["FIGURE_REF"].search(text) or RX["FIGURE_BELOW"].search(text))


def question(index: int, b: Block) -> dict:
    marks, stem, body = take_marks(b.lines[0], b.lines[1:], b.section_marks)
    choice = any(RX["OR_SEPARATOR"].match(x) for x in body)
    options, rest = take_options(body)
    text = " ".join(" ".join([stem, *rest]).split())
    figure = names_figure(text)
    kind = "mcq" if options else "long" if RX["CASE_STUDY"].search(text) or (marks or 0) >= 5 else "numerical" if RX["NUMERICAL_HINTS"].search(text) else "short"
    return {"question_index": index, "number": b.number, "section": b.section, "section_title": b.title, "text": text, "marks": marks, "type": kind, "options": options or None, "has_figure": figure, "page": b.page, "choice_group": b.number if choice else None, "chapter": " ".join(b.chapters) or None}


def parse(lines: list[tuple[int, str]]) -> dict:
    strategy, reading = choose(lines)
    return {"strategy": strategy, "declared_count": reading.declared or None, "sections": reading.sections, "rejected": reading.rejected, "questions": [question(k, b) for k, b in enumerate(reading.blocks)]}


def values(column: pa.Array) -> list:
    return column.to_pylist() if column.null_count else column.to_numpy(zero_copy_only=False).tolist()


def parsed_papers(lines: DataFrame, placed: bool = False) -> DataFrame:
    """PARSED, a row for each paper of lines (paper_id, page, line_no, text).
    Papers stream by in order, one in memory at a time. Lines that are dealt by
    paper (placed) aren't dealt again."""

    def run(batches):
        paper, kept = None, []

        def row():
            return {"paper_id": paper, **parse(kept)}

        for rows in batches:
            out = []
            for pid, page, text in zip(*(values(rows[c]) for c in ("paper_id", "page", "text"))):
                if pid != paper:
                    if kept:
                        out.append(row())
                    paper, kept = pid, []
                kept.append((page, text))
            if out:
                yield pa.RecordBatch.from_pylist(out, ROWS)
        if kept:
            yield pa.RecordBatch.from_pylist([row()], ROWS)

    rows = lines.select("paper_id", "page", "line_no", "text")
    ordered = (rows if placed else dealt(rows, "paper_id")).sortWithinPartitions("paper_id", "page", "line_no")
    return ordered.mapInArrow(run, PARSED)


def questions_of(parsed: DataFrame) -> DataFrame:
    return parsed.select("paper_id", F.explode("questions").alias("q")).select("paper_id", "q.*")
