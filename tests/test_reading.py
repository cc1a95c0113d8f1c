"""Calls, tiles, shapes and files, on small fixtures of our own."""

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from paperloom.functions import shapes
from paperloom.operators import ingest, tiling, vision, workflow
from paperloom.sources import calls, provider, readers
from paperloom.sources.calls import Reply, attempted, structured

from .test_engine import cutter

IMAGES = "paper_id string, page int, content binary"


# --- calls


def failing(*errors, then="done"):
    left = list(errors)

    def call():
        if left:
            raise RuntimeError(left.pop(0))
        return then

    return call


@pytest.mark.parametrize(
    "call, want, waits",
    [
        (failing(), ("finished", "done", 1), []),
        (failing(then=Reply("x", "tool_calls")), ("finished", "x", 1), []),
        (failing("503"), ("finished", "done", 2), [1.0]),
        (failing("rate_limit, try again in 3.5s"), ("finished", "done", 2), [4.0]),
        (failing("429, try again in 999s"), ("finished", "done", 2), [60.0]),
        (failing("timeout", "timeout", "timeout"), ("transport", None, 3), [1.0, 2.0]),
        (failing("429: tokens per day (TPD) are used up", "again"), ("quota", None, 1), []),
        (failing("bad key"), ("other", None, 1), []),
        (failing(then=Reply('{"questions": [', "length")), ("truncated", None, 1), []),
        (failing("timeout", then=Reply("x", "length")), ("truncated", None, 2), [1.0]),
        (failing(then=Reply("x", "content_filter")), ("other", None, 1), []),
        (failing(then=" "), ("other", None, 1), []),
        (failing(then=Reply(None)), ("other", None, 1), []),
    ],
)
def test_outcomes(call, want, waits):
    slept = []
    got = attempted(call, 3, 1.0, slept.append)
    assert (got.outcome, got.reply, got.calls) == want and slept == waits and (got.error is None) == (want[0] == "finished")


def test_structured_calls():
    assert structured(lambda: {"a": 1}) == structured(lambda: '```json\n{"a": 1}\n```') == structured(lambda: Reply('{"a": 1}', "stop")) == {"a": 1}
    for said in ("[1]", "no json", Reply('{"a": 1}', "length"), Reply(None)):
        with pytest.raises(ValueError):
            structured(lambda: said)


class Flaky(provider.OfflineProvider):
    """Solves at the third call; plans as a fenced text."""

    def __init__(self):
        super().__init__()
        self.calls = 0

    def plan(self, item):
        return '```\n{"complexity": "easy"}\n```'

    def solve(self, item):
        self.calls += 1
        if self.calls % 3:
            raise RuntimeError("502")
        return json.dumps(super().solve(item))


def test_solving_retries_and_leaves_failed_papers(spark, tmp_path):
    questions = spark.createDataFrame([("p", 0, "1", "Why?", 2, False), ("bad", 0, "1", "How?", 2, False)], "paper_id string, question_index int, number string, text string, marks int, has_figure boolean")
    papers = spark.createDataFrame([("p", "solving", "Maths"), ("bad", "failed", "Art")], "paper_id string, status string, subject string")
    (row,) = workflow.solve(workflow.work_items(questions), Flaky(), cutter(spark, tmp_path), papers=papers, pause=0.0).collect()
    assert (row.paper_id, row.subject, row.result_status, row.complexity, row.model_tier, row.attempts) == ("p", "Maths", "completed", "easy", "cheap", 1)


# --- tiles


class Blocks(provider.OfflineProvider):
    """A line that starts with a number and a tab starts a question, others go on
    with it; a cut question has what the tile shows of it. Six lines at most."""

    def __init__(self, most=6):
        super().__init__()
        self.most = most

    def read_image(self, image, page):
        lines = image.decode().split("\n")
        return Reply(json.dumps({"metadata": {"subject": lines[0]}, "questions": blocks(lines)}), "length" if len(lines) > self.most else "stop")


def blocks(lines):
    out = []
    for x in lines:
        number, _, text = x.rpartition("\t")
        if number or not out:
            out.append({"question_number": number or "?", "question_text": text, "options": [], "confidence": len(lines) / 100})
        else:
            out[-1]["question_text"] += " " + text
    return out


def merge(upper, lower):
    """Items of two tiles by number; an item that was there before goes."""
    out, seen = [], set()
    for x in [*upper, *lower]:
        key = x["question_number"], x["question_text"]
        if key in seen:
            continue
        seen.add(key)
        old = next((y for y in out if y["question_number"] == x["question_number"]), None)
        if old is None:
            out.append(dict(x))
            continue
        a, b = old["question_text"], x["question_text"]
        old["question_text"] = a if b in a else b if a in b else f"{a} {b}"
        old["confidence"] = min(old["confidence"], x["confidence"])
    return out


def recursion(lines, most=6, least=5, depth=0):
    """Items of a page, or None where a part can't be read."""
    if len(lines) <= most:
        return blocks(lines)
    if depth == 2 or len(lines) < least:
        return None
    n, over = len(lines), int(len(lines) * 0.25)
    out = []
    for part in (lines[: n // 2 + over], lines[max(n // 2 - over, 0) :]):
        items = recursion(part, most, least, depth + 1)
        if items is None:
            return None
        out = merge(out, items)
    return out


def test_frontier_equals_recursion(spark, tmp_path):
    rng = random.Random(3)
    pages = {}
    for k in range(40):
        number = 0
        lines = []
        for j in range(rng.choice([1, 6, 7, 8, 9, 10, 11, 12, 30])):
            number += not lines or rng.random() < 0.5
            lines.append((f"{number}\t" if not lines or not lines[-1].startswith(f"{number}\t") and rng.random() < 0.6 else "") + f"word{k}x{j}")
        pages[k + 1] = lines
    images = spark.createDataFrame([("p", k, "\n".join(x).encode()) for k, x in pages.items()], IMAGES)
    reads = tiling.read_pages(images, Blocks(), cutter(spark, tmp_path), tiling.LineTiler(), least_height=5).cache()
    good, bad = tiling.whole_pages(reads)
    got = {}
    for r in tiling.folded(vision.parse_items(good).drop("misfits")).orderBy("idx").collect():
        got.setdefault(r.page, []).append((r.number, r.text, r.confidence))
    want = {k: recursion(x) for k, x in pages.items()}
    assert {r.page for r in bad.collect()} == {k for k, x in want.items() if x is None} and len(got) > 15
    assert got == {k: [(i["question_number"], i["question_text"], i["confidence"]) for i in x] for k, x in want.items() if x is not None}
    assert {len(r.tile) for r in good.collect()} == {0, 1, 2}
    # metadata is that of the first tile
    assert vision.merge_metadata(vision.reply_metadata(good)).first().subject == pages[min(got)][0]


def test_cut_off_pages_without_a_tiler(spark, tmp_path):
    images = spark.createDataFrame([("p", 1, b"1\ta\n" * 9), ("q", 1, b"1\tWhat is it?"), ("q", None, b"x"), ("r", 0, b"x")], IMAGES)
    done = ingest.image_papers(images, Blocks(), cutter(spark, tmp_path))
    assert {r.paper_id for r in done.papers.collect()} == {"q"}
    errors = {(r.paper_id, r.page): r.message for r in done.diagnostics.where("code = 'unreadable'").collect()}
    assert errors == {("p", 1): "truncated: the reply was cut off", ("q", None): "other: nan is no page", ("r", 0): "other: 0 is no page"} or set(errors) == {("p", 1), ("q", None), ("r", 0)}


def test_a_tile_that_is_no_reply_takes_its_page_along(spark, tmp_path):
    replies = spark.createDataFrame([("p", 1, "0", '{"questions": [{"question_number": 1, "question_text": "a whole text"}]}'), ("p", 1, "1", "sorry"), ("p", 2, "", '{"questions": [{"question_number": 2, "question_text": "another text"}]}')], "paper_id string, page int, tile string, reply string")
    done = ingest.reply_papers(replies, cutter(spark, tmp_path))
    assert [r.number for r in done.questions.collect()] == ["2"] and done.diagnostics.where("code = 'unreadable'").count() == 1


def test_split_rows(spark):
    def raster(*darkness):
        return [(1, y, float(d)) for y, d in enumerate(darkness)]

    def split(rows, **how):
        return tiling.split_rows(spark.createDataFrame(rows, "page int, y int, darkness double"), **how).first().split

    assert split(raster(9, 0, 9, 9, 9, 9, 9, 9)) == 1  # the only light row
    assert split(raster(9, 9, 9, 0, 9, 0, 9, 9)) == 5  # of two as near the lower
    assert split(raster(9, 9, 9, 9, 9, 9)) == 3 and split(raster(0)) == 0
    assert split(raster(0, 9, 9, 9, 9, 9, 9, 9, 9), radius=2) == 4  # out of reach


# --- shapes


def test_wrongly_typed_fields_are_told(spark, tmp_path):
    reply = '{"metadata": 5, "questions": [{"question_number": 7.5, "question_text": ["a"], "marks": {"x": 1}, "options": [1, "b"], "has_figure": "yes", "section": 4, "confidence": "0.9"}, {"question_number": "8", "question_text": "Fine here", "has_figure": 0}]}'
    done = ingest.reply_papers(spark.createDataFrame([("p", 1, reply)], "paper_id string, page int, reply string"), cutter(spark, tmp_path))
    found = {r.message: (r.severity, r.question) for r in done.diagnostics.where("code = 'schema_invalid'").collect()}
    assert {k.split(":")[0]: v for k, v in found.items()} == {
        "questions[0].question_text": ("error", "7.5"), "questions[0].marks": ("warning", "7.5"), "questions[0].options[0]": ("error", "7.5"), "questions[0].has_figure": ("warning", "7.5"), "questions[0].confidence": ("warning", "7.5"),
        "questions[1].has_figure": ("warning", "8"),
    }
    one, two = done.questions.orderBy("question_index").collect()
    assert (one.text, one.marks, one.options, one.has_figure, one.section, one.confidence) == ('["a"]', None, ["1", "b"], True, "4", 0.0) and not two.has_figure


def test_odd_replies(spark):
    rows = [("p", 1, None), ("p", 2, "[]"), ("p", 3, '{"questions": [3]}'), ("p", 4, '{"questions": [{"question_number": null}]}'), ("p", 50_000, '{"questions": []}'), ("p", 50_001, '{"questions": [{"question_number": 1}]}')]
    got = vision.parse_items(spark.createDataFrame(rows, "paper_id string, page int, reply string")).collect()
    assert {r.page: r.error for r in got} == {1: "the reply is no object with a list of questions", 2: "the reply is no object with a list of questions", 3: "an item is no object", 4: "an item has no question_number", 50_001: None}
    assert next(r.idx for r in got if r.error is None) == 50_001 * 4 * 100_000


@pytest.mark.parametrize("said, want", [("0", False), ("0.0", False), ('""', False), ('"0"', True), ('"no"', True), ("[]", False), ("{}", False), ("[0]", True), ("null", False), ("true", True), ("2", True)])
def test_truth_of_values(spark, said, want):
    v = F.try_parse_json(F.lit(said))
    assert spark.range(1).select(shapes.truthy(v)).first()[0] is want


# --- files

PNG = bytes.fromhex("89504E470D0A1A0A")


class PngLines(provider.LineReader):
    def read_image(self, image, page):
        return super().read_image(image[8:], page)


def layer(content):
    if b"broken" in content:
        raise ValueError("broken file")
    return [content.decode().split("\n")[1:]]


def folder(tmp_path):
    at = tmp_path / "in"
    (at / "deep").mkdir(parents=True)
    files = {"a.pdf": b"%PDF-\n1 What is the longest of these words?\n2 Why is it so?", "b.png": PNG + b"1\tWhat is a noun?", "c.txt": b"plain", "d.pdf": b"%PDF- broken", "e.png": PNG + b"1\ta\n" * 50, "same.pdf": b"%PDF-\n1 What is the longest of these words?\n2 Why is it so?"}
    for name, content in files.items():
        (at / name).write_bytes(content)
    return at, files


def test_every_file_is_a_paper_or_has_an_error(spark, tmp_path):
    at, files = folder(tmp_path)
    done = ingest.ingest(spark, at, layer, PngLines(), cutter(spark, tmp_path), board="CBSE")
    prints = {k: hashlib.sha256(v).hexdigest() for k, v in files.items()}
    papers = {r.fingerprint: r for r in done.papers.collect()}
    assert set(papers) == {prints["a.pdf"], prints["b.png"]} and all(r.board == "CBSE" and r.paper_id == "pap_" + r.fingerprint[:8] for r in papers.values())
    errors = {r.fingerprint for r in done.diagnostics.where("code = 'unreadable'").collect()}
    assert errors == {prints[k] for k in ("c.txt", "d.pdf", "e.png")}
    assert {(r.paper_id, r.questions, r.ok) for r in ingest.summary(done).collect()} == {("pap_" + prints["a.pdf"][:8], 2, True), ("pap_" + prints["b.png"][:8], 1, True), *(("pap_" + prints[k][:8], 0, False) for k in ("c.txt", "d.pdf", "e.png"))}


def test_images_need_a_provider(spark, tmp_path):
    at, files = folder(tmp_path)
    done = ingest.file_papers(spark, str(at / "b.png"), layer, cutter(spark, tmp_path))
    assert done.papers.count() == 0
    assert [r.message for r in done.diagnostics.collect()] == ["other: no model was given that could read image"]


def test_bytes_and_lists(spark, tmp_path):
    at, files = folder(tmp_path)
    done = ingest.ingest(spark, files["a.pdf"], layer, PngLines(), cutter(spark, tmp_path))
    assert [(r.paper_id, r.total_questions) for r in done.papers.collect()] == [("pap_" + hashlib.sha256(files["a.pdf"]).hexdigest()[:8], 2)]
    (at / "z.png").write_bytes(PNG + b"2\tWhat is a verb?")
    done = ingest.ingest(spark, [at / "z.png", at / "b.png"], layer, PngLines(), cutter(spark, tmp_path / "list"))
    joined = hashlib.sha256(PNG + b"2\tWhat is a verb?" + files["b.png"]).hexdigest()
    paper = done.papers.first()
    assert (paper.fingerprint, paper.total_questions, paper.total_pages) == (joined, 2, 2)
    assert [(q["number"], q["page"]) for q in ingest.question_dicts(done, "pap_" + joined[:8])] == [("2", 1), ("1", 2)]
    for odd in ([], b"", 5, [at / "c.txt"]):
        with pytest.raises(ValueError):
            ingest.ingest(spark, odd, layer, PngLines(), cutter(spark, tmp_path))


def test_prints_of_joined_images(spark):
    rng = random.Random(1)
    groups = {g: [rng.randbytes(rng.choice([0, 1, 99, 100, 101, 1000])) for _ in range(rng.randrange(1, 6))] for g in "abcdefg"}
    rows = [(g, k, x) for g, xs in groups.items() for k, x in enumerate(xs)]
    rng.shuffle(rows)
    got = ingest.folded_prints(spark.createDataFrame(rows, "g string, page int, content binary"), "g", piece=100).collect()
    assert {(r.g, r.fingerprint, r.pages) for r in got} == {(g, hashlib.sha256(b"".join(xs)).hexdigest(), len(xs)) for g, xs in groups.items()}


def test_static_papers(spark, tmp_path):
    paper = {"paper_metadata": {"paper_id": "pap_1", "subject": "Maths", "total_marks": 5}, "questions": [{"number": "1", "text": "Why?", "marks": 2, "options": None}, {"number": "2", "text": "How?"}]}
    (tmp_path / "papers.json").write_text(json.dumps([paper], indent=1))
    papers, questions = readers.static_papers(spark, str(tmp_path / "papers.json"))
    assert [(r.paper_id, r.subject, r.total_marks, r.total_questions) for r in papers.collect()] == [("pap_1", "Maths", 5, 2)]
    assert [(r.paper_id, r.question_index, r.number, r.marks) for r in questions.orderBy("question_index").collect()] == [("pap_1", 0, "1", 2), ("pap_1", 1, "2", None)]


def test_calls_name_their_outcomes():
    assert calls.OUTCOMES == ("finished", "truncated", "quota", "transport", "other") and calls.OUTCOME.startswith("outcome string")


def test_a_wording_that_all_items_share_is_not_gathered(spark):
    item = "paper_id string, page int, idx long, number string, text string, marks string, kind string, options array<string>, confidence double, section string, has_figure boolean"
    rows = [("p", 1, k, "1", "Same text", "2" if k == 5 else None, "x", ["(B) b%d" % k, "(A) a", "free"][k % 3 :], 1 - k / 1000, None, False) for k in range(200)]
    (r,) = vision.dedupe_by_text(spark.createDataFrame(rows[::-1], item).repartition(4)).collect()
    want = spark.createDataFrame([([x[7] for x in rows],)], "o array<array<string>>").select(vision.option_union(F.col("o"))).first()[0]
    assert (r.idx, r.marks, r.confidence, r.options) == (0, "2", 1 - 199 / 1000, want) and len(want) == 202


def test_images_go_in_turns(spark, tmp_path):
    """More images are more turns of as many tasks, with the same reads; no task reads more than about task_bytes."""
    tasks, written = [], cutter(spark, tmp_path)

    def cut(df):
        if "outcome" in df.columns and "MapInPandas" in df._jdf.queryExecution().executedPlan().toString():
            tasks.append(df.rdd.mapPartitions(lambda rows: [sum(len(r.content or b"") for r in rows)]).collect())
        return written(df)

    images = spark.createDataFrame([(f"p{k % 7}", k + 1, b"\n".join(b"%d\tword%d" % (j, k) for j in range(1 + k % 9))) for k in range(60)] + [(None, None, b"x"), ("q", 1, None)], IMAGES)
    read = lambda **how: tiling.read_pages(images, provider.LineReader(4), cut, tiling.LineTiler(), concurrency=2, least_height=6, pause=0.0, **how)
    whole, rounds = sorted(map(repr, read().collect())), len(tasks)
    tasks.clear()
    assert sorted(map(repr, read(task_bytes=400).collect())) == whole and len(whole) > 62
    assert rounds == 3 and len(tasks) > 9 and len(tasks) % 3 == 0
    assert all(len(t) <= 2 for t in tasks) and max(map(max, tasks)) < 3 * 400
