"""Words one edit apart against all pairs."""

import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from paperloom.llm import variants

WORDS = "word string, n long"
RNG = random.Random(13)


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def plain(counts, ratio=10):
    near = {w: [v for v in counts if one_edit(w, v)] for w in counts}
    form = {}
    for w, found in near.items():
        top = min(found, key=lambda v: (-counts[v], v), default=None)
        if top is not None and counts[top] >= ratio * counts[w]:
            form[w] = top
    out = set()
    for w in counts:
        root = w
        while root in form:
            root = form[root]
        out.add((w, form.get(w), root, counts[w], len(near[w]), counts[form[w]] if w in form else None))
    return out


def drawn(letters, low, high, k):
    return {"".join(RNG.choices(letters, k=RNG.randrange(low, high))): RNG.choice([2, 3, 20, 25, 400, 9000]) for _ in range(k)}


@pytest.mark.parametrize("counts", [drawn("ab", 1, 7, 150), drawn("abcé", 2, 6, 300), drawn("aàb", 1, 9, 250), {"": 50, "a": 5, "aa": 500, "b": 2}, {"lonely": 3}, {"x" * 3000 + "y": 2, "x" * 3000: 200, "x" * 2999 + "zy": 3000}, {f"wor{c}": 2 + ord(c) for c in "abcdefghijklmnopqrstuvwxyzéàü"}])
def test_against_all_pairs(spark, counts):
    got = variants.spelling_variants(spark.createDataFrame(list(counts.items()), WORDS)).select("word", "form", "root", "n", "n_near", "form_n").collect()
    assert len(got) == len(counts) and set(map(tuple, got)) == plain(counts)


@pytest.mark.parametrize("wide, prime", [(1, variants.PRIME), (1 << 40, variants.PRIME), (4, 97)])
def test_pairs_by_any_join_and_any_hash(spark, wide, prime):
    """No light edge is broadcast, all are; nodes and keys of only 97 values."""
    counts = drawn("abc", 2, 7, 150)
    got = variants.one_edit_pairs(spark.createDataFrame(list(counts.items()), WORDS), wide, prime).collect()
    assert sorted(map(tuple, got)) == sorted((a, b) for a in counts for b in counts if one_edit(a, b))


def test_a_word_is_copied_to_few_keys(spark):
    counts = drawn("abcdefgh", 8, 12, 3000)
    named = spark.createDataFrame(list(counts.items()), WORDS).select(F.xxhash64("word").alias("id"), "word")
    ways = sum(len(w) + 1 for w in counts)
    light = variants.light_edges(named).agg(F.sum("below")).first()[0]
    assert light < ways / 2  # words times light edges


def plain_words(rows):
    out = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{doc_id}:{run}".encode())
            if doc_id is not None and h % 31 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            if len(run) >= 7:
                out[run] += 1
    return {w: n for w, n in out.items() if n >= 2}


def test_query_against_plain_code(spark, tmp_path):
    stock = ["Information", "informations", "ÉTERNITÉ", "éternité", "straße", "schließlich", "Knowledge", "acknowledged", "seven77seven", "naïveté’s", "paragraph"]
    rows = [(k, " ".join(RNG.choices(stock, k=60))) for k in range(300)] + [(None, "Information " * 3), (5, None), (6, ""), (7, "x" * 500 + " " + "x" * 499)] * 2
    spark.createDataFrame([(*r, "s") for r in rows], "doc_id long, text string, word string").write.parquet(f"{tmp_path}/documents.parquet")
    got = variants.op11_variants(spark, str(tmp_path))
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    want = plain(plain_words(rows))
    assert len(want) > 30 and any(w[1] for w in want) and set(map(tuple, got.collect())) == want


def test_empty(spark):
    assert variants.spelling_variants(spark.createDataFrame([], WORDS)).count() == 0
    assert variants.counted_words(spark.createDataFrame([(None, None)], "doc_id long, text string")).count() == 0
