"""Periodic runs against every stretch and every period, tried out."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from paperloom.llm import periods

DOCS = "doc_id long, text string"


def smallest_period(words):
    return next(q for q in range(1, len(words) + 1) if all(a == b for a, b in zip(words, words[q:])))


def plain_runs(words, least=6, exponent=4):
    """All (start, length, period) by trying each stretch."""
    n, out = len(words), []
    for i in range(n):
        for j in range(i + 1, n + 1):
            q = smallest_period(words[i:j])
            if j - i >= max(least, exponent * q) and not (i and words[i - 1] == words[i - 1 + q]) and not (j < n and words[j] == words[j - q]):
                out.append((i, j - i, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_left(words, runs):
    gone = {k for s, length, q in runs for k in range(s + q, s + length)}
    return " ".join(w for k, w in enumerate(words) if k not in gone)


def texts():
    rng = random.Random(7)
    out = [None, "", " \n\t", "a", "a " * 6, "a " * 5, "a b " * 4, "a b " * 3, "x " + "a a b " * 5 + "a y", "a a a a a a b b b b b b " * 4]
    for k in range(60):
        words = rng.choices("ab" if k % 2 else "abc", k=rng.randrange(4, 40))
        if k % 3 == 0:
            words = words[:5] + words[5:8] * rng.randrange(3, 7) + words[8:]
        out.append(" ".join(words))
    return out


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([*enumerate(texts()), (3, "a"), (None, "z " * 9)], DOCS)


@pytest.mark.parametrize("whole_chars, compares", [(1 << 16, 1 << 25), (0, 7)])
def test_runs_against_every_stretch(docs, whole_chars, compares):
    """Both ways: whole texts, and ranges of lags that meet again."""
    got = periods.periodic_runs(docs, whole_chars=whole_chars, compares=compares, per_word=1).collect()
    assert len(got) == len(texts()) + 2
    for r in got:
        words = (r.text or "").split()
        want = plain_runs(words)
        assert [tuple(x) for x in r.runs] == want and r.collapsed == plain_left(words, want), r.text


def test_parameters(spark):
    text = "q " + "a b c " * 3 + "z"
    row = periods.periodic_runs(spark.createDataFrame([(1, text)], DOCS), least_words=2, exponent=2).first()
    assert [tuple(x) for x in row.runs] == plain_runs(text.split(), 2, 2) == [(1, 9, 3)] and row.collapsed == "q a b c z"


def test_ranges_cover_all_lags_once():
    for n in (0, 3, 4, 9, 1000):
        ends = periods.range_ends(n, 4, 500)
        assert ends == sorted(set(ends)) and (ends[-1:] or [0])[0] == n // 4
    assert len(periods.range_ends(1000, 4, 500)) == 250


def test_columns(spark, docs):
    extra = docs.withColumns({"row": F.lit(1), "k": F.lit(2), "low": F.lit(3), "runs": F.lit("own"), "collapsed": F.lit("own")})
    for out in (periods.periodic_runs(extra), periods.periodic_runs(extra, whole_chars=0)):
        assert out.columns == ["doc_id", "text", "row", "k", "low", "runs", "collapsed"]
        assert out.agg(F.sum("k")).first()[0] == 2 * docs.count() and out.where("collapsed = 'own'").isEmpty()
    assert periods.periodic_runs(spark.createDataFrame([], DOCS)).count() == 0


def test_long_text_in_ranges(spark):
    """A long text whose only run has a long period."""
    rng = random.Random(3)
    cycle = [f"w{rng.randrange(10**6)}" for _ in range(700)]
    text = " ".join(["lead", *cycle * 4, "tail"])
    row = periods.periodic_runs(spark.createDataFrame([(1, text)], DOCS), whole_chars=100, compares=1 << 18, per_word=1).first()
    assert [tuple(x) for x in row.runs] == [(1, 2800, 700)] and row.collapsed == " ".join(["lead", *cycle, "tail"])


def plain_edit(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[a + (i - a) % p] if i >= a else words[i] for i in range(n)]


def test_query_against_plain_code(spark, tmp_path):
    rng = random.Random(5)
    rows = [(k, t) for k, t in enumerate(texts())] + [(k, " ".join(rng.choices(["ñ", "b\x0b", "c\xa0d", "e"], k=k % 50))) for k in range(100, 260)] + [(None, "a " * 8), (-5, None)]
    spark.createDataFrame([(*r, "s") for r in rows], DOCS + ", source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r.doc_id, r.n_runs, r.start, r.length, r.period, r.exponent_milli, r.runs_sha256, r.collapsed_sha256) for r in periods.op13_periods(spark, str(tmp_path)).collect()}
    want, edited = set(), 0
    for doc_id, text in rows:
        words = plain_edit(doc_id, text)
        edited += words != re.findall(r"[^\x20\x09-\x0D]+", text or "")
        runs = plain_runs(words)
        top = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
        digests = (hashlib.sha256(x.encode()).hexdigest() for x in ("".join("%d,%d,%d\n" % r for r in runs), plain_left(words, runs)))
        want.add((doc_id, len(runs), *top, top[1] and 1000 * top[1] // top[2], *digests))
    assert edited > 5 and got == want
