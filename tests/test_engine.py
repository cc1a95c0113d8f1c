"""Layout, merge, store and workflow rules on small fixtures of our own."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from paperloom.functions.arithmetic import calculate, outcome
from paperloom.functions.context import KEYS, question_context
from paperloom.functions.identity import question_signature
from paperloom.functions.text import is_instruction, line_class, normalize_text, strip_fences
from paperloom.operators import dealing, diagnostics, ingest, pages, segment, store, vision, workflow
from paperloom.sources import provider, readers
from paperloom.sources.settings import Settings
from paperloom.streaming.checkpoints import current, upsert_stream


def parsed(*texts, page=1):
    return segment.parse([(page, t) for t in texts])


def numbers(out):
    return [q["number"] for q in out["questions"]]


# --- parser


def test_strict_numbers_and_bare_marks():
    out = parsed("1 What is a noun in this sentence?", "2", "2 Name a verb.", "1")
    assert numbers(out) == ["1", "2"] and [q["marks"] for q in out["questions"]] == [2, 1] and out["strategy"] == "strict"


def test_wrapped_lines_join_and_numbers_inside_stay():
    out = parsed("1 A train leaves at", "5 in the morning and arrives at", "9 at night.", "2 Why?")
    assert numbers(out) == ["1", "2"]
    assert out["questions"][0]["text"] == "A train leaves at 5 in the morning and arrives at 9 at night."


def test_question_keeps_its_first_page():
    out = segment.parse([(1, "1 This question goes on"), (2, "over the page."), (2, "2 Next?")])
    assert [q["page"] for q in out["questions"]] == [1, 2]


def test_relaxed_reading_of_gaps():
    out = parsed("7 Explain how rain is formed in the hills.", "8 Explain how snow is formed in the hills.", "12 Describe the course of a river to the sea.")
    assert out["strategy"] == "relaxed" and numbers(out) == ["7", "8", "12"] and out["rejected"] == []


def test_no_line_is_lost_to_an_instruction_that_declares_nothing():
    out = parsed("1 Read the passage below.", "Answer the following in brief.", "Why did he go?", "2 And then?")
    assert out["questions"][0]["text"] == "Read the passage below. Answer the following in brief. Why did he go?"


def test_numbers_are_whole_numbers():
    assert numbers(parsed("01 What is it?", "002 Why is it?")) == ["1", "2"]


def test_preamble_sections_and_declared_count():
    out = parsed("General Instructions:", "1. Write neatly.", "2. Use ink.", "Section A: Grammar", "Attempt all 2 questions. Each carries 3 marks.", "1 Correct this.", "2 Correct that.", "Part of the text", "Section B", "3 Say why.")
    assert numbers(out) == ["1", "2", "3"] and out["declared_count"] == 2 and out["sections"] == ["A", "B"]
    assert [(q["section"], q["section_title"], q["marks"]) for q in out["questions"]] == [("A", "Grammar", 3), ("A", "Grammar", 3), ("B", None, None)]


def test_marks_precedence():
    assert parsed("1 How did it end? 4", "tail")["questions"][0]["marks"] == 4
    assert parsed("1 Read this", "It ends here. 3")["questions"][0]["marks"] == 3  # one body line: ours, by design
    assert parsed("1 The value is 5.")["questions"][0]["marks"] is None
    assert parsed("1 Read", "Q12", "more")["questions"][0]["marks"] is None  # Q12 is text


def test_options_are_lifted_whole():
    q = parsed("1 Pick one.", "(A) red  (B) green", "(C) a long option that", "wraps", "(D) blue.", "After it all.")["questions"][0]
    assert q["options"] == ["(A) red", "(B) green", "(C) a long option that wraps", "(D) blue."] and q["type"] == "mcq" and q["text"] == "Pick one. After it all."
    q = parsed("1 Do both.", "(a) first part", "(A) not an option")["questions"][0]
    assert q["options"] is None and "(A) not an option" in q["text"]


def test_choice_chapter_figure():
    q = parsed("1 Draw the triangle shown in the figure.", "[Ch 4: Triangles]", "OR", "Draw a square.")["questions"][0]
    assert q["choice_group"] == "1" and q["chapter"] == "[Ch 4: Triangles]" and q["has_figure"] and "OR" in q["text"]


def test_lossless():
    lines = ["1 First words", "second words here", "(A) one", "(B) two.", "2 Third words", "5", "fourth words"]
    out = parsed(*lines)
    said = " ".join(" ".join([q["text"], *(q["options"] or []), str(q["marks"] or "")]) for q in out["questions"])
    for line in lines:
        for word in line.split()[1:] or line.split():
            assert word in said


def test_classes_and_furniture(spark):
    said = {"Page 3 of 9": "furniture", "Q.NO. Questions": "furniture", "Section IV": "section", "Attempt any 3 questions": "instruction", "or": "or", "12": "bare_number", "Instructions": "instructions_heading", "12) Why so?": "question", "Plain.": "content", " ": "blank", "[Ch 2: Sets]": "chapter"}
    rows = spark.createDataFrame([(k, v) for k, v in said.items()], "text string, want string")
    assert [r.text for r in rows.where(line_class(F.col("text")) != F.col("want")).collect()] == []
    lines = [("p", pg, k, t) for pg in (1, 2) for k, t in enumerate(["Test series 9", f"{pg} What is it now?", "This is said twice.", "Some text", f"Page {pg}/2"], 1)]
    kept = pages.without_furniture(spark.createDataFrame(lines, "paper_id string, page int, line_no int, text string"))
    heads = spark.createDataFrame([("p", pg, k, t) for pg in (1, 2) for k, t in enumerate(["Test series:", f"Body {pg}."], 1)], "paper_id string, page int, line_no int, text string")
    assert sorted(r.text for r in pages.without_furniture(heads).collect()) == ["Body 1.", "Body 2."]
    assert sorted({r.text for r in kept.collect()}) == ["1 What is it now?", "2 What is it now?", "This is said twice."]


# --- identity, arithmetic


def test_normalised_text_and_signatures(spark):
    rows = spark.createDataFrame([("Q.1: What  is\tit?",), ("what is it?",), ("“Yes” – no.",), ("1) One:",), (" Q1. kept",), (None,)], "t string")
    assert [r[0] for r in rows.select(normalize_text(F.col("t"))).collect()] == ["what is it?", "what is it?", '"yes" - no', "one", "q1. kept", ""]
    q = spark.createDataFrame([("a", 1, ["(A) x"]), ("a", 2, ["(A) x"]), ("a", 1, ["(A) y"]), ("A.", 1, ["(A)  X."]), ("a", None, None), ("a", 0, [])], "t string, m int, o array<string>")
    s = [r[0] for r in q.select(question_signature(F.col("t"), F.col("m"), options=F.col("o"))).collect()]
    assert s[0] == s[3] and s[4] == s[5] and len(set(s)) == 4


@pytest.mark.parametrize("said, value", [("2 + 3 * 4", 14), ("-7 // 2", -4), ("-7 % 3", 2), ("2 ** 10", 1024), ("+1.5", 1.5)])
def test_arithmetic(said, value):
    assert calculate(said) == value


@pytest.mark.parametrize("said", ["", "1 +", "x", "True + 1", "2 ** 101", "1 / 0", "(-8) ** 0.5", "9 ** 99 * 9 ** 99", "1" * 201, "__import__('os')"])
def test_arithmetic_refuses(said):
    with pytest.raises(ValueError):
        calculate(said)


# --- diagnostics

GOOD = ("p", 0, "1", "A", "A whole question", 3, "short", None, False, 1)
COLUMNS = "paper_id string, question_index int, number string, section string, text string, marks int, type string, options array<string>, has_figure boolean, page int"
PAPER = ("p", 1, 1, 3, 1, ["A"])
PAPERS = "paper_id string, total_questions int, total_pages int, declared_total_marks int, declared_question_count int, declared_sections array<string>"


def codes(spark, *changes, paper=PAPER, source="pdf"):
    names = [c.split()[0] for c in COLUMNS.split(", ")]
    rows = []
    for k, change in enumerate(changes):
        row = dict(zip(names, GOOD)) | {"question_index": k, "number": str(k + 1), "text": f"A whole question {k}"} | change
        rows.append(tuple(row[n] for n in names))
    fixed = (*paper[:1], len(rows), paper[2], None, None, paper[5])
    return sorted({r.code for r in diagnostics.report(spark.createDataFrame([fixed], PAPERS), spark.createDataFrame(rows, COLUMNS), source).collect()})


@pytest.mark.parametrize("change, code", [({"number": " "}, "missing_number"), ({"text": " "}, "empty_text"), ({"text": "ab"}, "suspiciously_short_text"), ({"page": 0}, "invalid_page"), ({"type": "essay"}, "invalid_type"), ({"marks": 101}, "invalid_marks"), ({"options": []}, "empty_options"), ({"options": ["(A) x", " "]}, "invalid_option"), ({"type": "mcq"}, "mcq_without_options"), ({"has_figure": True}, "figure_without_reference"), ({"section": "B"}, "inconsistent_section"), ({"page": 2}, "page_out_of_range"), ({"marks": None}, "unknown_marks"), ({"number": "2"}, "numbering_starts_above_one"), ({"number": "²"}, None)])
def test_one_broken_rule(spark, change, code):
    found = codes(spark, change)
    assert (code in found) if code else found == []


def test_paper_rules(spark):
    assert codes(spark, {}) == []
    assert {"duplicate_number", "duplicate_text"} <= set(codes(spark, {"text": "Same"}, {"number": "1", "text": "same!"}))
    assert {"impossible_ordering", "numbering_gap"} <= set(codes(spark, {"number": "4"}, {"number": "1"}))
    assert "numbering_gap" in codes(spark, {"number": "1"}, {"number": "999999999"})
    assert "partial_sections" in codes(spark, {}, {"section": None})
    assert "section_reappears" in codes(spark, {}, {"section": "B"}, {})
    empty = diagnostics.no_questions(spark.createDataFrame([PAPER], PAPERS), spark.createDataFrame([], COLUMNS))
    assert [r.code for r in empty.collect()] == ["no_questions"]
    with pytest.raises(diagnostics.InvalidPapers):
        diagnostics.raise_if_invalid(empty)


def test_first_missing_numbers_are_named(spark):
    names = [c.split()[0] for c in COLUMNS.split(", ")]
    for numbers, missing in (([1, *range(3, 80, 2)], range(2, 25, 2)), ([50, 1, 2, 2, 9], range(3, 16)), ([5, 8], (6, 7))):
        rows = [tuple((dict(zip(names, GOOD)) | {"question_index": k, "number": str(n), "text": f"A whole question {k}"})[c] for c in names) for k, n in enumerate(numbers)]
        found = diagnostics.report(spark.createDataFrame([PAPER], PAPERS), spark.createDataFrame(rows, COLUMNS)).where("code = 'numbering_gap'").collect()
        assert [r.message for r in found] == ["missing " + ", ".join(str(n) for n in [m for m in missing if m not in numbers][:12])]


# --- vision items


def test_replies_to_items(spark):
    replies = [("p", 4, '```json\n{"questions": [{"question_number": 7, "question_text": "This OR that", "marks": "2.0", "question_type": "odd", "section": "Section b", "source_page": 99}]}\n```'), ("p", 5, "sorry"), ("p", 6, '{"questions": 3}'), ("p", 7, '{"questions": [{"question_number": 8}, {"question_text": "no number"}]}')]
    items = vision.parse_items(spark.createDataFrame(replies, "paper_id string, page int, reply string"))
    assert items.where("error is not null").count() == 3
    (q,) = vision.canonical(items).collect()
    assert (q.number, q.page, q.marks, q.type, q.section, q.choice_group, q.options) == ("7", 4, 2, "short", "B", "7", None)
    assert spark.range(1).select(strip_fences(F.lit(" x "))).first()[0] == "x"


ITEM = "paper_id string, page int, idx long, number string, text string, marks string, kind string, options array<string>, confidence double, section string, has_figure boolean"


def test_vision_steps_chain(spark):
    rows = [("p", 1, 1, " 1", "This OR that", "2", "mcq", ["(A) x"], 0.9, "A", True, "1"), ("p", 1, 2, "1 ", " This OR that", None, "mcq", ["(B) y"], 0.4, None, False, None), ("p", 1, 3, "i", "this or THAT", None, "short", [], 0.8, None, False, None)]
    items = spark.createDataFrame(rows, ITEM + ", choice_group string")
    merged = vision.merge_tiles(items)
    assert sorted(merged.columns) == sorted(items.columns)
    (q,) = vision.canonical(vision.dedupe_across_pages(vision.dedupe_by_text(merged))).collect()
    assert (q.section, q.choice_group, q.has_figure, q.type, q.marks, q.options, q.confidence) == ("A", "1", True, "mcq", 2, ["(A) x", "(B) y"], 0.4)


def test_tiles_merge(spark):
    rows = [("p", 1, 1, "1", "Find x", None, "mcq", ["(A) 1", "(B) 2"], 0.9, None, False), ("p", 1, 2, "1", "Find x in this", "3", "mcq", ["(b) two", "(C) 3", "free"], 0.4, "A", True), ("p", 1, 3, "1", "and y", None, "mcq", [], 0.8, "B", False), ("p", 1, 4, "2", "Other", None, "mcq", [], 0.8, None, False), ("p", 1, 5, "2", "Other", None, "mcq", [], 0.8, None, False)]
    one, two = sorted(vision.merge_tiles(spark.createDataFrame(rows, ITEM)).collect(), key=lambda r: r.number)
    assert (one.text, one.marks, one.options, one.confidence, one.section, one.has_figure) == ("Find x in this and y", "3", ["(A) 1", "(B) 2", "(C) 3", "free"], 0.4, "A", True)
    assert two.text == "Other"


def test_text_dedupe_spares_texts_without_a_key(spark):
    rows = [("p", 1, 1, "1", "Same text", None, "x", ["(A) 1"], 0.9, None, False), ("p", 1, 2, "i", "same TEXT!", "2", "x", ["(B) 2"], 0.5, None, False), ("p", 2, 3, "1", "Same text", None, "x", [], 0.9, None, False), ("p", 1, 4, "2", "हिन्दी", None, "x", [], 0.9, None, False), ("p", 1, 5, "3", "বাংলা", None, "x", [], 0.9, None, False)]
    got = {r.idx: r for r in vision.dedupe_by_text(spark.createDataFrame(rows, ITEM)).collect()}
    assert sorted(got) == [1, 3, 4, 5] and got[1].options == ["(A) 1", "(B) 2"] and got[1].marks == "2" and got[1].confidence == 0.5


# --- store

SOLVED = "paper_id string, work_item_id string, id long, question_signature string, question_number string, needs_teacher_check boolean, verification_status string, model_used string, prompt_version string, confidence double, answer string, verified_by string, marks int"


def solved(spark, *rows):
    return spark.createDataFrame(rows, SOLVED)


def test_lookup_gate_and_payload(spark):
    rows = solved(spark, ("p", "p:q:0000", 1, "s", "1", False, "passed", "m", "v", 0.95, "old", "v", 1), ("p", "p:q:0001", 2, "s", "2", False, "passed", "m", "v", 0.95, "new", "v", 1), ("q", "q:q:0000", 3, "t", "1", True, "passed", "m", "v", 0.99, "x", "v", 1), ("q", "q:q:0001", 4, "u", "2", False, "passed", "m", "v", 0.5, "x", "v", 1))
    items = spark.createDataFrame([("s",), ("t",), ("u",), ("none",)], "question_signature string")
    got = {r.question_signature: r for r in store.cache_lookup(items, rows).collect()}
    assert got["s"].cached_answer == "new" and got["s"].cached_by == "cache:signature:v"
    assert [got[k].cache_status for k in ("s", "t", "u", "none")] == ["hit", "miss", "miss", "miss"]
    papers = spark.createDataFrame([("p", "ready", 2), ("q", "ready", 2), ("r", "ready", 0), ("s", "ready", 1)], "paper_id string, status string, total_questions int")
    assert {r.paper_id: r.hit for r in store.paper_gate(papers, rows).collect()} == {"p": True, "q": False, "r": False, "s": False}
    assert [r.total_questions for r in store.payload(papers, rows).collect()] == [2]


def test_upserts_are_idempotent(spark):
    papers = spark.createDataFrame([("p", "parsing", "Maths", 5)], "paper_id string, status string, subject string, total_questions int")
    updates = spark.createDataFrame([("p", "solving", "", 0), ("q", "parsing", "Art", 1)], papers.schema)
    once = store.upsert_papers(papers, updates)
    assert sorted(map(tuple, once.collect())) == [("p", "solving", "Maths", 5), ("q", "parsing", "Art", 1)]
    assert sorted(map(tuple, store.upsert_papers(once, updates).collect())) == sorted(map(tuple, once.collect()))
    old = solved(spark, ("p", "w", 1, "s", "1", False, "passed", "m", "v", 0.9, "old", "v", 1))
    new = solved(spark, ("p", "w", 2, "s", "1", None, "failed", "m", "v", 0.1, "new", "v", None))
    (row,) = store.upsert_checkpoints(old, new).collect()
    assert (row.answer, row.marks, row.needs_teacher_check) == ("new", 0, True)
    assert store.upsert_checkpoints(store.upsert_checkpoints(old, new), new).count() == 1


# --- workflow


class Broken(provider.OfflineProvider):
    def plan(self, item):
        raise RuntimeError("no planner")

    def solve(self, item):
        if item["number"] == "0":
            raise RuntimeError("worker down")
        return super().solve(item)

    def review(self, item, solution):
        if item["number"] == "1":
            raise RuntimeError("no verdict")
        return super().review(item, solution)


def test_solve_loop(spark, tmp_path):
    rows = [("p", k, str(k), f"Question {k}", 2, k == 2) for k in range(7)]
    items = workflow.work_items(spark.createDataFrame(rows, "paper_id string, question_index int, number string, text string, marks int, has_figure boolean"))

    def cut(df, n=[0]):
        n[0] += 1
        df.write.parquet(f"{tmp_path}/{n[0]}")
        return spark.read.parquet(f"{tmp_path}/{n[0]}")

    done = {r.number: r for r in workflow.solve(items, Broken(), cut, 2).collect()}
    assert len(done) == 7
    assert (done["0"].result_status, done["0"].attempts) == ("failed", 2)
    assert (done["1"].result_status, done["1"].confidence) == ("needs_review", 0.45)
    assert done["2"].result_status == "needs_review" and not done["2"].has_solution
    assert (done["3"].result_status, done["3"].confidence, done["3"].store) == ("completed", 0.99, True)
    assert done["5"].attempts == 2


class Careful(provider.OfflineProvider):
    """Passes what was told of an issue, reads figures, plans by the text."""

    def plan(self, item):
        if item["number"] == "0":
            raise RuntimeError("no planner")
        if item["number"] == "1":
            return {"complexity": "odd"}
        request = {"name": "calculator", "expression": "2 * 21"}
        return {"complexity": "easy", "model_tier": "own", "needs_vision": item["number"] in "34", "tool_requests": [{"name": "search"}, request, {"name": "calculator", "expression": "1 / 0"}, request, request]}

    def solve(self, item):
        context = json.loads(item["context"])
        said = "; ".join(str(r["result"]) for r in context["tool_results"] or [])
        return super().solve(item) | {"answer": f"{item['model_tier']} {said} {context['figure_interpretation'] or ''} {','.join(item['feedback'])}".strip()}

    def review(self, item, solution):
        good = item["number"] != "2" or item["feedback"] == ["the unit is missing"]
        return super().review(item | {"attempts": 1}, solution) | {"passed": good, "issues": [] if good else ["the unit is missing"]}

    def interpret_figure(self, image):
        return f"{len(image)} bytes"


def test_plan_cache_figures_and_feedback(spark, tmp_path):
    rows = [("p", k, str(k), f"Question {k}", 2, False, b"abc" if k == 3 else None, "s" if k == 5 else f"none{k}") for k in range(6)]
    items = workflow.work_items(spark.createDataFrame(rows, "paper_id string, question_index int, number string, text string, marks int, has_figure boolean, figure_image binary, question_signature string"))
    known = solved(spark, ("p", "p:q:0000", 1, "s", "1", False, "passed", "m", "v", 0.95, "old", "v", 1))

    def cut(df, n=[0]):
        n[0] += 1
        df.write.parquet(f"{tmp_path}/{n[0]}")
        return spark.read.parquet(f"{tmp_path}/{n[0]}")

    done = {r.number: r for r in workflow.solve(items, Careful(), cut, 2, solved=known).collect()}
    assert len(done) == 6
    assert (done["0"].plan_error, done["0"].model_tier, done["0"].answer) == ("no planner", "standard", "standard")
    assert (done["1"].plan_error, done["1"].complexity) == ("the plan names no complexity", "moderate")
    assert (done["2"].attempts, done["2"].answer, done["2"].result_status) == (2, "cheap 42.0; None; 42.0  the unit is missing", "completed")
    assert (done["3"].answer, done["3"].result_status) == ("cheap 42.0; None; 42.0 3 bytes", "completed")
    assert (done["4"].generation_error, done["4"].result_status) == (workflow.NO_FIGURE, "needs_review")
    assert (done["5"].answer, done["5"].result_status, done["5"].attempts, done["5"].store, done["5"].verified_by) == ("old", "completed", 0, False, "cache:signature:v")


def test_dispatch_and_context(spark):
    items = spark.createDataFrame([("p", "1"), ("q", "1"), ("none", "1")], "paper_id string, number string")
    papers = spark.createDataFrame([("p", "solving", "Maths"), ("q", "failed", "Art")], "paper_id string, status string, subject string")
    out = workflow.dispatched(items, papers)
    (row,) = out.select("paper_id", question_context(out).alias("c")).collect()
    assert row.paper_id == "p" and list(json.loads(row.c)) == list(KEYS)
    assert json.loads(row.c) == dict.fromkeys(KEYS) | {"question_number": "1", "question_text": "", "has_figure": False, "subject": "Maths"}


# --- ingest


def cutter(spark, folder):
    def cut(df, n=[0]):
        n[0] += 1
        df.write.parquet(f"{folder}/cut{n[0]}")
        return spark.read.schema(df.schema).parquet(f"{folder}/cut{n[0]}")

    return cut


def test_files_to_papers(spark, tmp_path):
    pages_of = {b"%PDF-good": [["Subject: Maths  |  Class: 10", "Total Marks: 5", "Section A", "1 What is a prime number, in words? 2", "Page 1/2"], ["2 Prove that two is one. 3", "9 apples are here", "Page 2/2"]], b"%PDF-twice": [["1 What is a prime number in words?", "1 What is a prime number in words, then?"]], b"%PDF-short": [["x"]]}
    (tmp_path / "in").mkdir()
    for k, content in enumerate([*pages_of, b"%PDF-broken", b"GIF89a"]):
        (tmp_path / "in" / f"{k}.pdf").write_bytes(content)
    done = ingest.file_papers(spark, str(tmp_path / "in"), lambda content: pages_of[content], cutter(spark, tmp_path), board="CBSE")
    ids = {k: "pap_" + hashlib.sha256(k).hexdigest()[:8] for k in [*pages_of, b"%PDF-broken", b"GIF89a"]}
    papers = {r.paper_id: r for r in done.papers.collect()}
    good = papers[ids[b"%PDF-good"]]
    assert len(papers) == 2 and (good.subject, good.class_name, good.board, good.total_questions, good.total_marks, good.sections, good.total_pages, good.declared_total_marks) == ("Maths", "10", "CBSE", 2, 5, ["A"], 2, 5)
    found = {(r.paper_id, r.code) for r in done.diagnostics.collect()}
    assert {c for p, c in found if p == good.paper_id} == {"rejected_question_candidate"}
    assert {(ids[k], "unreadable") for k in (b"%PDF-short", b"%PDF-broken", b"GIF89a")} == {f for f in found if f[1] == "unreadable"}
    assert [q["number"] for q in ingest.question_dicts(done, good.paper_id)] == ["1", "2"]
    with pytest.raises(diagnostics.InvalidPapers):
        done.raise_if_invalid()


class Reader(provider.OfflineProvider):
    def read_image(self, image, page):
        if image == b"bad":
            raise RuntimeError("no model")
        return image.decode()


def test_images_to_papers(spark, tmp_path):
    def reply(*questions, **metadata):
        return json.dumps({"metadata": metadata, "questions": [{"question_number": n, "question_text": t, "marks": m, "question_type": "short", "section": "Section A", "confidence": c} for n, t, m, c in questions]}).encode()

    images = [("p", 1, reply(("1", "What is a noun?", 2, 0.9), ("i", "what is a NOUN", None, 0.9))), ("p", 2, reply(("1", "What is a noun?", 2, 0.9), ("2", "What is a verb?", 3, 0.3), subject="English")), ("q", 1, b"bad"), ("r", 1, b"no json"), ("s", 0, reply())]
    done = ingest.image_papers(spark.createDataFrame(images, "paper_id string, page int, content binary"), Reader(), cutter(spark, tmp_path))
    papers = {r.paper_id: r for r in done.papers.collect()}
    p = papers["p"]
    assert (p.subject, p.total_questions, p.total_marks, p.sections, p.total_pages) == ("English", 2, 5, ["A"], 2)
    assert [(q["question_index"], q["number"], q["page"]) for q in ingest.question_dicts(done, "p")] == [(0, "1", 1), (1, "2", 2)]
    found = {(r.paper_id, r.code) for r in done.diagnostics.collect()}
    assert {c for k, c in found if k == "p"} == {"low_confidence"}
    assert {("q", "unreadable"), ("r", "unreadable"), ("r", "no_questions"), ("s", "unreadable")} <= found


def test_paper_status(spark):
    papers = spark.createDataFrame([("none",), ("lost",), ("part",), ("fine",)], "paper_id string")
    results = spark.createDataFrame([("lost", "failed"), ("part", "failed"), ("part", "completed"), ("fine", "needs_review")], "paper_id string, status string")
    errors = spark.createDataFrame([], "paper_id string")
    assert {r.paper_id: r.status for r in workflow.paper_status(papers, results, errors).collect()} == {"none": "failed", "lost": "failed", "part": "partial", "fine": "ready"}


# --- sources, settings, streaming


def test_retries_and_registry():
    waits, calls = [], []

    def call():
        calls.append(1)
        if len(calls) < 3:
            raise RuntimeError("429, try again in 90s" if len(calls) == 1 else "timeout")
        return "ok"

    assert provider.with_retries(call, 3, 1.0, waits.append) == "ok" and waits == [60.0, 2.0]
    with pytest.raises(RuntimeError):
        provider.with_retries(lambda: (_ for _ in ()).throw(RuntimeError("bad key")), 3, 1.0, waits.append)
    with pytest.raises(provider.CapabilityUnavailable):
        provider.provider("nowhere")
    with pytest.raises(provider.CapabilityUnavailable):
        provider.generate_image("x")
    assert Settings.read({"PAPERLOOM_MAX_ATTEMPTS": "x", "PAPERLOOM_RETRIES": "0", "PAPERLOOM_STORE": "no"}) == Settings(store_enabled=False)


def test_binaries_and_pages(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1 " + b"x" * 100)
    (tmp_path / "b.png").write_bytes(bytes.fromhex("89504E470D0A1A0A") + b"x")
    (tmp_path / "c.jpg").write_bytes(b"GIF89a")
    (tmp_path / "d.pdf").write_bytes(b"")  # Spark's reader has no row for an empty file
    files = readers.binaries(spark, str(tmp_path))
    got = {r.path[-5:]: (r.kind, r.error is None, r.paper_id[:4]) for r in files.collect()}
    assert got == {"a.pdf": ("pdf", True, "pap_"), "b.png": ("png", True, "pap_"), "c.jpg": ("other", False, "pap_")}
    assert readers.images(spark, str(tmp_path)).count() == 2
    lines = readers.paper_pages(files, lambda content: [["1 A question of some length is here", " "], ["and another line"]]).collect()
    assert [(r.page, r.line_no) for r in lines] == [(1, 1), (2, 1)]
    assert [r.error for r in readers.paper_pages(files, lambda c: [["short"]]).collect()][0].startswith("the file has no text")


def test_books_round_trip(spark, tmp_path):
    book = spark.createDataFrame([("p", "f", "ready", {"subject": "Maths"}, 0, []), ("q", "g", "ready", {}, 0, [])], readers.BOOK)
    readers.write_books(book, str(tmp_path / "books"))
    (row,) = readers.read_book(spark, str(tmp_path / "books"), "p").collect()
    assert row.metadata == {"subject": "Maths"}
    assert readers.read_book(spark, str(tmp_path / "books"), "none").count() == 0


def test_stream_upserts(spark, tmp_path):
    schema = "k string, n int, v string"
    for k, rows in enumerate([[("a", 1, "x"), ("b", 1, "y")], [("a", 2, "z")]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        seen = []
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        upsert_stream(stream, str(tmp_path / "t"), str(tmp_path / "c"), ["k"], ["n"], lambda b, n: seen.append(n)).awaitTermination()
        assert seen
    assert sorted(map(tuple, current(spark, str(tmp_path / "t")).collect())) == [("a", 2, "z"), ("b", 1, "y")]


def test_tasks_grow_with_the_rows(spark):
    """What is sorted by paper is dealt to more tasks where there are more rows."""
    lines = spark.createDataFrame([(str(p), n, 1, "Some words") for p in range(50) for n in (1, 2, 3)], "paper_id string, page int, line_no int, text string")
    few, many = pages.without_furniture(lines), pages.without_furniture(lines, size=9 * dealing.TASK_ROWS)
    assert few.rdd.getNumPartitions() <= 4 and many.rdd.getNumPartitions() == 9
    assert sorted(many.collect()) == sorted(few.collect())
    assert dealing.dealt(lines, "paper_id", task_rows=10).rdd.getNumPartitions() == 15  # counted


def test_expressions_are_calculated_once():
    outcome.cache_clear()
    assert [outcome(e) for e in ("7 // 2", "1 / 0", "7 // 2", None, None)][:3] == [(3.0, None), (None, "division by zero"), (3.0, None)]
    assert outcome.cache_info().hits == 2


def test_lines_of_papers_are_dealt_and_written_once(spark, tmp_path):
    """Placed lines go through clean pages and the parse without another exchange; no row holds a set of pages."""
    plans = []

    def cut(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return cutter(spark, tmp_path)(df)

    said = [("a", 1, 1, "Running head"), ("a", 1, 2, "1 Find x? 3"), ("a", 2, 1, "Running head"), ("a", 2, 2, "2 Find y? 4"), ("a", 3, 1, "Page 3 of 3"), ("b", 1, 1, "Running head"), ("b", 1, 2, "Subject: Maths"), ("b", 1, 3, "1 Say it?")]
    lines = spark.createDataFrame(said, "paper_id string, page int, line_no int, text string").repartition("paper_id")
    papers = ingest.text_papers(lines, cut, placed=True).papers
    assert len(plans) == 1 and plans[0].count("Exchange") == 1 and "collect_set" not in plans[0], plans
    assert sorted(papers.select("paper_id", "total_pages", "total_questions", "total_marks", "subject").collect()) == [("a", 3, 2, 7, None), ("b", 1, 1, None, "Maths")]
    assert sorted(r.text for r in pages.without_furniture(lines).collect() if r.paper_id == "a") == ["1 Find x? 3", "2 Find y? 4"]


def test_instructions_are_told_by_their_start_first(spark):
    said = ["Attempt all 3 questions.", "\u00a0 answer any 2 questions", "Answering carries 2 marks", "The answer carries 2 marks", "Attempt 1", "Section A", "\n\tATTEMPT 2 out of 3", "\u00a0", "", None, "13", "1 Attempt all 3 questions."]
    rows = spark.createDataFrame([(x,) for x in said], "text string").select("text", F.coalesce(is_instruction(F.col("text")), F.lit(False)).alias("is"), (line_class(F.col("text")) == "instruction").alias("want"))
    got = rows.collect()
    assert [r["is"] for r in got] == [r["want"] for r in got] and sum(r["is"] for r in got) == 3
