"""Secrets in texts: known shapes, and strings of high entropy.

Known shapes are patterns (an assignment to a word like password, an access key,
long lower-case hexadecimals). What they leave is searched for candidate strings:
20 or more characters of base64 and its variants. A candidate belongs to a class
by its characters (hexadecimal, letters of one case and digits, any letters and
digits); each class has the entropy that a window must have. A window slides over
the candidate: a character's entering and leaving change its counts, and with them
S, the sum of c*log2(c) over the counts c, so no window is counted anew. Its
Shannon entropy is log2(w) - S/w. Hot windows that touch are one span. Names,
paths, identifiers of known form and sample keys are suppressed by an allow-list.

S is in whole 2^-20ths, so that sums are exact in any order.

Native: DataFrame functions only, within a row; nothing is shuffled. Places are
running sums of the lengths of matches and of what lies between them, in blocks,
so that a text of very many matches costs no square of their number.

Defined results: a null or empty text has no span; candidates without a digit
are of no class; a candidate may hold a known shape that starts later in it (both
are reported); repeated rows and rows without an id are rows like any other;
further columns stay, but for one that has the name of the added one, which is
replaced.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

WORDS = ("password", "passwd", "secret", "token", "api_?key")
#: A text with an assignment has one of these, once lower-cased.
PLAIN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
KEYWORD = "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in WORDS)
ASSIGN = rf"""(?:{KEYWORD})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS, HEX = "AKIA[A-Z0-9]{16,}", "[0-9a-f]{24,}"
LEAST_VALUE = 6
RUN = "[A-Za-z0-9+/_-]{20,}"
CANDIDATE = RUN + "={0,2}"
#: What is searched at each place, in this order: a candidate is what no known shape takes there.
TOKENS = f"{ASSIGN}|{ACCESS}|{HEX}|{CANDIDATE}"
KINDS = ("assign", "access", "hex", "entropy")

WINDOW = 20


class CharacterClass(NamedTuple):
    """Candidates that match `shape`, and the bits that a window needs."""

    shape: str
    bits: float


#: The first class that a candidate matches is its class. At these bits a window of
#: most random strings of 32 characters is hot, and of few names in any language.
CLASSES = (CharacterClass("^(?:[0-9a-f]+|[0-9A-F]+)$", 3.0), CharacterClass("^(?:[0-9a-z]+|[0-9A-Z]+)$", 3.5), CharacterClass("^.*$", 3.8))
#: UUIDs; words, names and numbers between separators.
ALLOWED = (
    "^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    "^[-_/+]*(?:[A-Za-z]+[0-9]{0,4}|[0-9]{1,8})(?:[-_/+]+(?:[A-Za-z]+[0-9]{0,4}|[0-9]{1,8}))*[-_/+]*=*$",
)
#: Lower-cased parts of samples.
ALLOWED_PARTS = ("example", "sample", "placeholder", "changeme", "xxxxxxxx", "abcdefgh", "12345678", "qwertyui")

PIECES = 256
SCALE = 1 << 20
#: Characters are counted from '+' on, up to 'z'.
FIRST, SYMBOLS = ord("+"), ord("z") - ord("+") + 1


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def sums_before(lengths: Column) -> Column:
    """Running sums of an array without the element's own: inside blocks, then
    over the blocks."""
    zero = F.array(F.lit(0).cast("long"))
    add = lambda got, x: F.concat(got, F.array(F.element_at(got, -1) + x))
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / PIECES).cast("int")), lambda b: F.aggregate(F.slice(lengths, b * PIECES + 1, PIECES), zero, add))

    def joined(sums: Column) -> Column:
        before = F.aggregate(sums, zero, lambda got, s: add(got, F.element_at(s, -1)))
        return F.flatten(F.zip_with(sums, F.slice(before, F.lit(1), F.size(sums)), lambda s, o: F.transform(F.slice(s, F.lit(1), F.size(s) - 1), lambda v: v + o)))

    return F.when(F.size(lengths) > 0, bound(blocks, joined)).otherwise(F.array().cast("array<bigint>"))


def matches(text: Column, pattern: str) -> Column:
    """(start, end, said) of the matches, in code points; an empty array where
    there are none."""
    none = F.array().cast("array<struct<start:bigint,end:bigint,said:string>>")
    size = lambda x: F.length(x).cast("long")

    def placed(said: Column) -> Column:
        between = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(said))

        def from_gaps(gaps: Column) -> Column:
            starts = F.zip_with(sums_before(F.zip_with(gaps, said, lambda g, s: size(g) + size(s))), gaps, lambda at, g: at + size(g))
            return F.zip_with(starts, said, lambda at, s: F.struct(at.alias("start"), (at + size(s)).alias("end"), s.alias("said")))

        return F.when(F.size(said) == 0, none).otherwise(bound(between, from_gaps))

    return bound(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed)


def spans(found: Column, kind: str) -> Column:
    return F.transform(found, lambda m: F.struct(m["start"].alias("start"), F.lit(KINDS.index(kind)).alias("rank"), m["end"].alias("end")))


def assigned_spans(text: Column) -> Column:
    """Assignments whose value is long enough."""
    sound = lambda m: F.length(F.regexp_extract(m["said"], f"^{ASSIGN}", 1)) >= LEAST_VALUE
    return spans(F.filter(matches(text, ASSIGN), sound), "assign")


def key_spans(text: Column) -> Column:
    return F.concat(spans(matches(text, ACCESS), "access"), spans(matches(text, HEX), "hex"))


def fixed(c: int) -> int:
    """c*log2(c) in 2^-20ths."""
    return round(c * math.log2(c) * SCALE) if c else 0


def largest_sum(bits: float, window: int) -> int:
    """The greatest S of a window of so many bits or more."""
    return math.floor((window * math.log2(window) - window * bits) * SCALE)


def hot_spans(said: Column, limit: Column, window: int = WINDOW) -> Column:
    """(start, end), inside the string, of its hot windows; those that touch are one."""
    terms = F.array(*(F.lit(fixed(c)).cast("long") for c in range(window + 2)))
    term = lambda c: F.get(terms, c)
    chars = F.transform(F.filter(F.split(said, ""), lambda c: c != ""), lambda c: F.ascii(c) - FIRST)
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    empty = F.struct(F.array_repeat(F.lit(0), SYMBOLS).alias("counts"), F.lit(0).cast("long").alias("s"), F.lit(0).cast("long").alias("at"), F.lit(-1).cast("long").alias("start"), F.lit(-1).cast("long").alias("end"), none.alias("done"))

    def step(got: Column, x: Column) -> Column:
        enters, leaves = x["0"], x["1"]
        counts = F.transform(got["counts"], lambda c, i: c + F.when(i == enters, 1).otherwise(0) - F.when(i == leaves, 1).otherwise(0))
        n_in, n_out = F.get(got["counts"], enters), F.get(got["counts"], leaves)
        change = F.when(leaves == enters, 0).otherwise(term(n_in + 1) - term(n_in) + F.when(leaves < 0, 0).otherwise(term(n_out - 1) - term(n_out)))

        def next_state(s: Column) -> Column:
            at, first = got["at"] + 1, got["at"] + 1 - window
            hot, open_, touches = (first >= 0) & (s <= limit), got["end"] >= 0, first <= got["end"]
            return F.struct(
                counts.alias("counts"), s.alias("s"), at.alias("at"),
                F.when(hot & ~touches, first).otherwise(got["start"]).alias("start"),
                F.when(hot, at).otherwise(got["end"]).alias("end"),
                F.when(hot & open_ & ~touches, F.concat(got["done"], F.array(F.struct(got["start"].alias("start"), got["end"].alias("end"))))).otherwise(got["done"]).alias("done"),
            )

        return bound(got["s"] + change, next_state)

    def closed(got: Column) -> Column:
        return F.when(got["end"] < 0, got["done"]).otherwise(F.concat(got["done"], F.array(F.struct(got["start"].alias("start"), got["end"].alias("end")))))

    def slid(codes: Column) -> Column:
        left = F.slice(F.concat(F.array_repeat(F.lit(-1), window), codes), F.lit(1), F.size(codes))
        return F.aggregate(F.zip_with(codes, left, lambda a, b: F.struct(a.alias("0"), b.alias("1"))), empty, step, closed)

    return bound(chars, slid)


def allowed(said: Column, patterns: tuple[str, ...], parts: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | said.rlike(p)
    for p in parts:
        out = out | F.contains(F.lower(said), F.lit(p))
    return out


def entropy_spans(text: Column, classes: tuple[CharacterClass, ...] = CLASSES, window: int = WINDOW, patterns: tuple[str, ...] = ALLOWED, parts: tuple[str, ...] = ALLOWED_PARTS) -> Column:
    """Spans of high entropy, of candidates with a digit that aren't allowed."""

    def suspect(m: Column) -> Column:
        said = m["said"]
        whole = said.rlike(f"^(?:{CANDIDATE})$") & ~said.rlike(f"^(?:{ACCESS}|{HEX})$")
        return whole & said.rlike("[0-9]") & ~allowed(said, patterns, parts)

    def limit(said: Column) -> Column:
        out = F.lit(-1).cast("long")
        for c in reversed(classes):
            out = F.when(said.rlike(c.shape), F.lit(largest_sum(c.bits, window)).cast("long")).otherwise(out)
        return out

    def hot(m: Column) -> Column:
        inside = bound(limit(m["said"]), lambda top: hot_spans(m["said"], top, window))
        return F.transform(inside, lambda s: F.struct((m["start"] + s["start"]).alias("start"), F.lit(KINDS.index("entropy")).alias("rank"), (m["start"] + s["end"]).alias("end")))

    return F.flatten(F.transform(F.filter(matches(text, TOKENS), suspect), hot))


def secret_spans(docs: DataFrame, name: str = "spans") -> DataFrame:
    """docs with `name`: an array of (start, rank, end) of all spans, by start,
    then by their kind's place in KINDS; end is exclusive."""
    text = F.coalesce("text", F.lit(""))
    none = F.array().cast("array<struct<start:bigint,rank:int,end:bigint>>")
    # most texts have no such word and no such run, and need no further search
    has_word = reduce(Column.__or__, (F.contains(F.lower(text), F.lit(w)) for w in PLAIN_WORDS))
    assigned = F.when(has_word, assigned_spans(text)).otherwise(none)
    others = F.when(text.rlike(RUN), F.concat(key_spans(text), entropy_spans(text))).otherwise(none)
    return docs.select(*(c for c in docs.columns if c != name), F.array_sort(F.concat(assigned, others)).alias(name))


def listed(spans: Column) -> Column:
    """kind:start:end of each, comma-joined."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["rank"]), s["start"], s["end"])), ",")


def op12_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = secret_spans(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "spans")
    counts = [F.size(F.filter("spans", lambda s: s["rank"] == KINDS.index(kind))).cast("long").alias(f"n_{kind}") for kind in KINDS[:3]]
    base = F.filter("spans", lambda s: s["rank"] < 3)
    return rows.select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def placed_sql(name: str, pattern: str) -> str:
    """A table of (doc_id, start, said): the matches of a pattern."""
    return f"""{name}_lists AS (SELECT doc_id, regexp_extract_all(t, {quoted(pattern)}, 0) AS m, string_split_regex(t, {quoted(pattern)}) AS b FROM d),
{name}_rows AS (SELECT doc_id, k, m[k] AS said, length(b[k]) AS gap FROM (SELECT *, unnest(range(1, len(m) + 1)) AS k FROM {name}_lists)),
{name} AS (SELECT doc_id, said, (sum(gap + length(said)) OVER (PARTITION BY doc_id ORDER BY k) - length(said))::BIGINT AS start FROM {name}_rows)"""


LIMIT_SQL = "CASE " + " ".join(f"WHEN regexp_matches(said, {quoted(c.shape)}) THEN {largest_sum(c.bits, WINDOW)}" for c in CLASSES) + " END"
ALLOWED_SQL = " OR ".join([f"regexp_matches(said, {quoted(p)})" for p in ALLOWED] + [f"contains(lower(said), '{p}')" for p in ALLOWED_PARTS])
TERMS_SQL = "[" + ", ".join(str(fixed(c)) for c in range(WINDOW + 1)) + "]"

#: Windows are counted anew here, each by its own characters.
ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
{placed_sql("assigned", ASSIGN)},
{placed_sql("access", ACCESS)},
{placed_sql("hexes", HEX)},
{placed_sql("tokens", TOKENS)},
suspects AS (
  SELECT *, row_number() OVER (ORDER BY doc_id, start) AS id, {LIMIT_SQL} AS most FROM tokens
  WHERE regexp_full_match(said, {quoted(CANDIDATE)}) AND NOT regexp_full_match(said, {quoted(f"{ACCESS}|{HEX}")}) AND regexp_matches(said, '[0-9]') AND NOT ({ALLOWED_SQL})),
windows AS (SELECT *, unnest(range(0, length(said) - {WINDOW} + 1)) AS g FROM suspects),
counted AS (SELECT id, g, any_value(doc_id) AS doc_id, any_value(start) AS start, any_value(most) AS most, ch, count(*) AS c
  FROM (SELECT *, unnest(string_split(substr(said, g + 1, {WINDOW}), '')) AS ch FROM windows) GROUP BY id, g, ch),
hot AS (SELECT id, g, any_value(doc_id) AS doc_id, any_value(start) AS start FROM counted GROUP BY id, g HAVING sum({TERMS_SQL}[c + 1]) <= any_value(most)),
marked AS (SELECT *, coalesce(g > lag(g) OVER (PARTITION BY id ORDER BY g) + {WINDOW}, true) AS opens FROM hot),
islands AS (SELECT *, sum(opens::INT) OVER (PARTITION BY id ORDER BY g) AS island FROM marked),
found AS (
  SELECT doc_id, start, 0 AS rank, start + length(said) AS stop FROM assigned WHERE length(regexp_extract(said, {quoted("^" + ASSIGN)}, 1)) >= {LEAST_VALUE}
  UNION ALL SELECT doc_id, start, 1, start + length(said) FROM access
  UNION ALL SELECT doc_id, start, 2, start + length(said) FROM hexes
  UNION ALL SELECT any_value(doc_id), any_value(start) + min(g), 3, any_value(start) + max(g) + {WINDOW} FROM islands GROUP BY id, island),
said AS (
  SELECT doc_id, start, rank, [{", ".join(map(quoted, KINDS))}][rank + 1] || ':' || start || ':' || stop AS s FROM found)
SELECT d.doc_id, count(*) FILTER (rank = 0) AS n_assign, count(*) FILTER (rank = 1) AS n_access, count(*) FILTER (rank = 2) AS n_hex,
       sha256(coalesce(string_agg(s, ',' ORDER BY start, rank) FILTER (rank < 3), '')) AS base_sha256, coalesce(string_agg(s, ',' ORDER BY start, rank), '') AS spans
FROM d LEFT JOIN said ON d.doc_id = said.doc_id GROUP BY d.doc_id
"""
