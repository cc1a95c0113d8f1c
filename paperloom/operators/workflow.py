"""Questions through plan, cache, generation, verification and repair.

Everything that is decided is a column; a provider is called from mapInPandas,
for the rows that still need it. The cache is joined before planning, so a hit
costs no call. The loop runs at most max_attempts times, each over unfinished
rows only; finished rows leave it. What a review objects to is told to the next
attempt."""

from __future__ import annotations

import json
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.arithmetic import calculate
from ..functions.context import question_context
from ..functions.identity import work_item_id
from ..functions.scoring import STORE_LEAST, blank, confidence, payload_errors, strictly
from ..sources.calls import structured
from ..sources.provider import Provider, with_retries
from .store import cache_lookup

COMPLEXITIES, MAX_REQUESTS = ("easy", "moderate", "hard"), 4
MAX_ATTEMPTS, LEAST_CORRECTNESS, NO_VERDICT = 2, 0.8, 0.45
#: Calls of a request that fails for a passing reason, and seconds between them.
RETRIES, PAUSE = 3, 1.0


def work_items(questions: DataFrame, max_attempts: int = MAX_ATTEMPTS) -> DataFrame:
    return questions.select(work_item_id(F.col("paper_id"), F.col("question_index")).alias("work_item_id"), *questions.columns, F.lit(0).alias("attempts"), F.lit(max_attempts).alias("max_attempts"), F.lit("miss").alias("cache_status"))


def prepared(items: DataFrame) -> DataFrame:
    """(paper_id, total_questions, errors, status): one bad item fails a paper."""
    missing = F.filter(F.array(*(F.when(F.col(c).isNull(), c) for c in ("work_item_id", "question_index", "number", "text"))), lambda x: x.isNotNull())
    bad = (F.size(missing) > 0) | blank(F.col("work_item_id")) | blank(F.col("number")) | blank(F.col("text"))
    ids = items.groupBy("paper_id", "work_item_id").agg(F.count("*").alias("n"), F.count_if(bad).alias("bad"))
    out = ids.groupBy("paper_id").agg(F.sum("n").alias("total_questions"), (F.sum("bad") + F.sum(F.when(F.col("work_item_id").isNotNull(), F.col("n") - 1).otherwise(0))).alias("errors"))
    return out.withColumn("status", F.when(F.col("errors") > 0, "failed").otherwise("solving"))


def fallback_plan(items: DataFrame) -> DataFrame:
    """complexity, model_tier and needs_vision without a planner."""
    text = F.coalesce("text", F.lit(""))
    hard = (F.length(text) > 500) | reduce(Column.__or__, (F.contains(F.lower(text), F.lit(w)) for w in P.HARD_WORDS))
    return items.withColumn("complexity", F.when(hard, "hard").otherwise("moderate")).withColumn("model_tier", F.when(hard, "reasoning").otherwise("standard")).withColumn("needs_vision", F.coalesce(F.col("has_figure"), F.lit(False)))


def model_tier(complexity: Column, wanted: Column) -> Column:
    """The planner's tier if it is one, else by complexity; null where the
    complexity is none, which means the fallback plan."""
    own = F.when(complexity == "hard", "reasoning").when(complexity == "easy", "cheap").otherwise("standard")
    return F.when(complexity.isin("easy", "moderate", "hard"), F.when(wanted.isin("cheap", "standard", "reasoning"), wanted).otherwise(own))


def calculated(requests: list | None) -> list[dict]:
    """Results of the calculator's requests among the first MAX_REQUESTS; what
    can't be calculated has its error."""
    out = []
    for r in requests[:MAX_REQUESTS] if isinstance(requests, list) else []:
        if not isinstance(r, dict) or r.get("name") != "calculator":
            continue
        said = {"name": "calculator", "purpose": str(r.get("purpose", "")), "expression": str(r.get("expression", "")), "result": None, "error": None}
        try:
            out.append(said | {"result": float(calculate(said["expression"]))})
        except Exception as e:
            out.append(said | {"error": str(e)})
    return out


PLANNED = "work_item_id string, said_complexity string, said_tier string, said_vision boolean, tool_results array<struct<name:string,purpose:string,expression:string,result:double,error:string>>, plan_error string"
PLAN_FIELDS = ["work_item_id", "said_complexity", "said_tier", "said_vision", "tool_results", "plan_error"]


def planned(items: DataFrame, provider: Provider, concurrency: int, retries: int = RETRIES, pause: float = PAUSE) -> DataFrame:
    """items with complexity, model_tier, needs_vision, tool_results and
    plan_error by the planner; where it fails or names no complexity, its error
    and the fallback's plan."""

    def one(row: dict) -> dict:
        out = dict.fromkeys(PLAN_FIELDS) | {"work_item_id": row["work_item_id"]}
        try:
            plan = structured(lambda: provider.plan(row), retries, pause)
            if plan.get("complexity") not in COMPLEXITIES:
                raise ValueError("the plan names no complexity")
            return out | {"said_complexity": plan["complexity"], "said_tier": plan.get("model_tier"), "said_vision": plan.get("needs_vision") is True, "tool_results": calculated(plan.get("tool_requests"))}
        except Exception as e:  # a planner's failure is its row's fallback
            return out | {"plan_error": str(e)}

    def run(batches):
        for rows in batches:
            yield pd.DataFrame([one(r) for r in rows.to_dict("records")], columns=PLAN_FIELDS)

    asked = items.select("work_item_id", "number", "text", "marks", question_context(items).alias("context"))
    plans = asked.repartition(concurrency, "work_item_id").mapInPandas(run, PLANNED)
    own = F.col("plan_error").isNull()
    rows = fallback_plan(items).join(plans, "work_item_id")
    return rows.withColumns({
        "model_tier": F.when(own, model_tier(F.col("said_complexity"), F.col("said_tier"))).otherwise(F.col("model_tier")),
        "complexity": F.when(own, F.col("said_complexity")).otherwise(F.col("complexity")),
        "needs_vision": F.when(own, F.col("said_vision")).otherwise(F.col("needs_vision")),
    }).drop("said_complexity", "said_tier", "said_vision")


def dispatched(items: DataFrame, papers: DataFrame) -> DataFrame:
    """Items to be solved, with what their paper states (subject, class_name,
    board): those of failed papers go straight to their paper's status."""
    facts = [c for c in ("subject", "class_name", "board") if c in papers.columns and c not in items.columns]
    return items.join(papers.where("status is null or status <> 'failed'").select("paper_id", *facts), "paper_id")


def verdict(items: DataFrame) -> DataFrame:
    """status and score of reviewed rows: has_solution, review_error, passed,
    correctness, answer_review_passed, independent_check_passed, needs_vision,
    has_image, and the solution's columns."""
    passed = strictly(F.col("passed")) & F.coalesce(F.col("correctness") >= LEAST_CORRECTNESS, F.lit(False)) & strictly(F.col("answer_review_passed")) & strictly(F.col("independent_check_passed")) & ~(strictly(F.col("needs_vision")) & ~strictly(F.col("has_image")))
    rows = items.withColumn("status", F.when(~F.col("has_solution"), "failed").when(F.col("review_error").isNotNull(), "needs_review").when(passed, "passed").otherwise("failed"))
    score = confidence(F.col("answer"), F.col("steps"), F.col("mark_split"), F.col("marks"), F.lit(True), F.col("answer_review_passed"), F.col("independent_check_passed"), F.col("status"))
    return rows.withColumn("confidence", F.when(~F.col("has_solution"), 0.0).when(F.col("review_error").isNotNull(), NO_VERDICT).otherwise(score))


def route(items: DataFrame) -> DataFrame:
    """next: finalize, or generate once more while attempts are left."""
    return items.withColumn("next", F.when(F.col("status") == "passed", "finalize").when(F.col("attempts") < F.col("max_attempts"), "generate").otherwise("finalize"))


def finalized(items: DataFrame) -> DataFrame:
    """result_status, needs_teacher_check and store of rows that leave the loop."""
    passed = (F.col("status") == "passed") & F.col("has_solution")
    hopeless = F.coalesce(F.lower("generation_error").rlike("figure|diagram|vision|ambiguous"), F.lit(False))
    return items.withColumns({
        "needs_teacher_check": ~passed | (F.col("confidence") < STORE_LEAST),
        "result_status": F.when(passed, "completed").when(F.col("has_solution") | hopeless, "needs_review").otherwise("failed"),
        "store": passed & (F.col("confidence") >= STORE_LEAST),
    })


CALLED = "work_item_id string, answer string, steps array<string>, mark_split array<struct<marks:int,`for`:string>>, common_mistakes array<struct<wrong:string,why:string>>, generation_error string, passed boolean, correctness double, answer_review_passed boolean, independent_check_passed boolean, review_error string, issues array<string>"
FIELDS = ["work_item_id", "answer", "steps", "mark_split", "common_mistakes", "generation_error", "passed", "correctness", "answer_review_passed", "independent_check_passed", "review_error", "issues"]
NO_FIGURE = "the figure isn't available"


def called(items: DataFrame, provider: Provider, concurrency: int, retries: int = RETRIES, pause: float = PAUSE) -> DataFrame:
    """One generation and one review of each row. A row that fails has its
    error; it never fails its neighbours. concurrency bounds the calls made at
    once. A figure that is needed is interpreted first; without its image there
    is no call."""

    def one(row: dict) -> dict:
        out = dict.fromkeys(FIELDS) | {"work_item_id": row["work_item_id"]}
        if row["needs_vision"]:
            if not row["figure_image"]:
                return out | {"generation_error": NO_FIGURE}
            try:
                said = with_retries(lambda: provider.interpret_figure(bytes(row["figure_image"])), retries, pause)
                row = row | {"context": json.dumps(json.loads(row["context"]) | {"figure_interpretation": said}, ensure_ascii=False)}
            except Exception as e:
                return out | {"generation_error": f"the figure can't be interpreted: {e}"}
        try:
            out |= structured(lambda: provider.solve(row), retries, pause)
        except Exception as e:  # a worker's failure is its row's result
            return out | {"generation_error": str(e)}
        try:
            return out | structured(lambda: provider.review(row, out), retries, pause)
        except Exception as e:
            return out | {"review_error": str(e)}

    def run(batches):
        for rows in batches:
            rows["feedback"] = [list(x) for x in rows["feedback"]]
            yield pd.DataFrame([one(r) for r in rows.to_dict("records")], columns=FIELDS)

    columns = ["work_item_id", "number", "text", "marks", "attempts", "needs_vision", "model_tier", "feedback", "figure_image"]
    return items.select(*columns, question_context(items).alias("context")).repartition(concurrency, "work_item_id").mapInPandas(run, CALLED)


def from_cache(hits: DataFrame) -> DataFrame:
    """Results of items that the cache holds: completed without a call, and not
    stored again."""
    return hits.withColumns({
        "answer": F.col("cached_answer"), "confidence": F.col("cached_confidence"), "verified_by": F.col("cached_by"), "status": F.lit("passed"), "has_solution": F.lit(True),
        "needs_teacher_check": F.lit(False), "result_status": F.lit("completed"), "store": F.lit(False),
    })


def solve(items: DataFrame, provider: Provider, cut, concurrency: int = 8, max_attempts: int = MAX_ATTEMPTS, solved: DataFrame | None = None, papers: DataFrame | None = None, retries: int = RETRIES, pause: float = PAUSE) -> DataFrame:
    """Results of all items. cut writes a DataFrame and reads it back, so that
    no call is repeated when a result is used again or an executor is lost.
    solved: rows that items with a question_signature may reuse. figure_image:
    items may have one. papers (paper_id, status, ...): items of failed ones are
    not solved, the others get what their paper states."""
    hits = None
    if papers is not None:
        items = cut(dispatched(items, papers))
    if solved is not None:
        looked = cut(cache_lookup(items.drop("cache_status"), solved))
        hits = from_cache(looked.where("cache_status = 'hit'"))
        items = looked.where("cache_status = 'miss'").select(*items.columns)
    if "figure_image" not in items.columns:
        items = items.withColumn("figure_image", F.lit(None).cast("binary"))
    todo = cut(planned(items, provider, concurrency, retries, pause).withColumn("feedback", F.array().cast("array<string>")))
    done = []
    for attempt in range(1, max_attempts + 1):
        rows = todo.withColumn("attempts", F.lit(attempt)).join(called(todo, provider, concurrency, retries, pause), "work_item_id")
        errors = payload_errors(F.col("answer"), F.col("steps"), F.col("mark_split"), F.col("common_mistakes"), F.col("marks"))
        rows = rows.withColumn("has_solution", F.col("generation_error").isNull() & (F.size(errors) == 0)).withColumn("generation_error", F.coalesce("generation_error", F.when(F.size(errors) > 0, F.array_join(errors, "; ")))).withColumn("has_image", F.col("figure_image").isNotNull())
        told = F.when(F.col("review_error").isNotNull(), F.array(F.concat(F.lit("the review failed: "), F.col("review_error")))).when(F.col("has_solution"), F.coalesce("issues", F.array().cast("array<string>"))).otherwise(F.col("feedback"))
        rows = cut(route(verdict(rows)).withColumn("feedback", told))
        done.append(rows.where("next = 'finalize'"))
        todo = rows.where("next = 'generate'").select(*todo.columns)
    out = finalized(reduce(DataFrame.unionByName, done)).drop("figure_image")
    return out if hits is None else out.unionByName(hits.drop("figure_image"), allowMissingColumns=True)


ITEM, RESULT = "item", "result"


def matched(items: DataFrame, results: DataFrame) -> DataFrame:
    """(row, paper_id, work_item_id, question_index, number, status, error): a row
    of kind ITEM for each expected item, with its result's status, and one of kind
    RESULT for each result, with what is wrong with it. Both are dealt by work item
    together and looked at there; a result without an id meets none, and is told
    apart before."""
    columns = ["paper_id", "work_item_id", "question_index"]
    expected = items.select(F.lit(ITEM).alias("row"), *columns, "number", F.lit(None).cast("string").alias("said"), F.lit(None).cast("long").alias("arrival"))
    got = results.select(F.lit(RESULT).alias("row"), *columns, F.lit(None).cast(items.schema["number"].dataType).alias("number"), F.col("status").alias("said"), F.col("arrival").cast("long").alias("arrival"))
    by_item = Window.partitionBy("work_item_id")
    index = F.max(F.when(F.col("row") == ITEM, F.col("question_index"))).over(by_item)
    rows = expected.unionByName(got.where("work_item_id is not null")).withColumn("index", index)
    valid = (F.col("row") == RESULT) & F.coalesce(F.col("question_index") == F.col("index"), F.lit(False))
    first = F.min(F.when(valid, F.struct("arrival", "said"))).over(by_item)
    rows = rows.withColumns({"valid": valid, "first": first})
    late = F.col("arrival") > F.col("first.arrival")
    wrong = F.when(F.col("index").isNull(), "unexpected_work_item_id").when(late, "duplicate_result").when(~F.col("valid"), "wrong_question_index")
    status = F.when(F.col("row") == ITEM, F.coalesce("first.said", F.lit("failed")))
    error = F.when(F.col("row") == RESULT, wrong).otherwise(F.when(F.col("first").isNull(), "no_result"))
    out = rows.select("row", *columns, "number", status.alias("status"), error.alias("error"))
    lost = got.where("work_item_id is null").select("row", *columns, "number", F.lit(None).cast("string").alias("status"), F.lit("no_work_item_id").alias("error"))
    return out.unionByName(lost)


def reconciled(items: DataFrame, results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(results in order, one for each expected item; errors). results carry
    `arrival`, their order. Of several results of an item the first with the
    right index counts; a result without id, of an unknown item or with a wrong
    index is an error, and an item without result fails."""
    rows = matched(items, results)
    return rows.where(F.col("row") == ITEM).select("paper_id", "work_item_id", "question_index", "number", "status"), rows.where("error is not null").select("paper_id", "work_item_id", "error")


def paper_status(papers: DataFrame, results: DataFrame, errors: DataFrame) -> DataFrame:
    """(paper_id, total, failed, errors, status); a paper without items failed."""
    counts = results.groupBy("paper_id").agg(F.count("*").alias("total"), F.count_if(F.col("status") == "failed").alias("failed"))
    wrong = errors.groupBy("paper_id").agg(F.count("*").alias("errors"))
    rows = papers.select("paper_id").join(counts, "paper_id", "left").join(wrong, "paper_id", "left").fillna(0, ["total", "failed", "errors"])
    return rows.withColumn("status", F.when(F.col("failed") == F.col("total"), "failed").when((F.col("failed") > 0) | (F.col("errors") > 0), "partial").otherwise("ready"))
