"""Best-fit packing of tokenised documents by bin completion.

1. One Arrow pass turns each text into token pieces (no text leaves it): the
   place, length and checksum of each. Pieces are written once.
2. Packing only depends on how many pieces have each length, so it is solved on
   that histogram, which has at most `size` rows however large the corpus is.
   solve() builds sequences around the largest length left: it enumerates the
   undominated fillings of what that leaves free, fullest first (by the sums
   that the lengths left can reach), and applies each as often as the counts
   allow, then less often. A branch is pruned when the waste it would add
   takes the total past the incumbent's, which starts as best-fit decreasing;
   the search ends when a solution meets the bound (by volume, or by pieces
   over a half), when all ways are tried, or after STEPS steps.
   A quick search over few fillings gives the whole one its incumbent.
3. Pieces of a length are numbered, in as many salted groups as their count
   asks for, so that a length that very many documents share is no single task.
   Each number finds its sequence and offset among the ranges that the solved
   layout has for its length.

Only step 2 runs in one place, on a table of at most `size` rows. The layout that
goes back has a row for each length of each kind of sequence; the groups' first
numbers are joined as Spark finds best by their size (a row for about GROUP
pieces). Free style: the
tokens come from tiktoken's form of the same vocabulary, whose ids equal the
tokenizers library's (tests/llm holds both against each other).

Defined results: a null or empty text is the one token that ends a document; a
repeated row is packed as often as it is there; a null id keeps its pieces;
rows of one id are told apart by a row number of their own; an empty table
gives no row; further columns are not read.
"""

from __future__ import annotations

import base64
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import vocabulary
from .common import map_rows, table, written

SIZE, END_ID = 2048, 0
SPECIAL = {"<|endoftext|>": 50256}
#: Steps of each search (quick, then whole) beyond its first descent; a longer
#: search gives the incumbent, which is a whole packing all the same. None: no
#: bound, so that the search only ends at the best packing.
STEPS = 4_000
#: Pieces of a length that are numbered in one group, about.
GROUP = 50_000


@lru_cache
def encoding(ranks_path: str):
    import public_tokenizers
    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=SPECIAL)


@lru_cache
def slow_encoding():
    """The tokenizers library's form of the same vocabulary."""
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))


def token_bytes(enc, text: str | None, end_id: int = END_ID) -> bytes:
    """Little-endian unsigned 32-bit ids of the whole text, then end_id."""
    try:
        ids = enc.encode_to_numpy(text or "", allowed_special="all", disallowed_special=())
    except ValueError:  # its pattern engine gives up on very long white space
        ids = np.array(slow_encoding().encode(text, add_special_tokens=False).ids)
    return np.append(ids.astype("<u4"), np.array([end_id], "<u4")).tobytes()


def pieces_of(n: int, size: int) -> list[tuple[int, int]]:
    """(start, length): only more than size tokens are cut; the first piece is
    what whole ones leave over."""
    first = n % size or min(n, size)
    return [(0, first), *((s, size) for s in range(first, n, size))]


def token_pieces(docs: DataFrame, ranks_path: str, size: int = SIZE) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document."""

    def make():
        enc = encoding(ranks_path)

        def each(doc_id, text):
            data = memoryview(token_bytes(enc, text))
            return [(doc_id, k, s, n, zlib.crc32(data[4 * s : 4 * (s + n)])) for k, (s, n) in enumerate(pieces_of(len(data) // 4, size))]

        each.many = True
        return each

    return map_rows(docs, ["doc_id", "text"], "doc_id long, piece int, start long, length long, ids_crc32 long", make)


Layout = list[tuple[tuple[int, ...], int]]  # (lengths in a sequence, how many such sequences)


def best_fit(counts: dict[int, int], size: int) -> Layout:
    """Best-fit decreasing, for many equal pieces at a time: the largest length
    that fits is added until none fits."""
    left, out = dict(sorted(counts.items(), reverse=True)), []
    while left:
        fill, use, free = [], Counter(), size
        for n in left:
            k = min(free // n, left[n])
            fill += [n] * k
            free -= k * n
            if k:
                use[n] = k
        times = min(left[n] // k for n, k in use.items())
        out.append((tuple(fill), times))
        for n, k in use.items():
            left[n] -= k * times
            if not left[n]:
                del left[n]
    return out


def fillings(lengths: list[int], left: dict[int, int], free: int, slack: int) -> Iterator[tuple[int, tuple[int, ...], bool]]:
    """All ways to fill `free` with lengths (largest first), at most `slack`
    short of it, fullest first: room left, filling, and whether it is
    undominated: what could still take a length that is left is dominated by
    the filling that takes it. The first always is."""
    mask = (1 << (free + 1)) - 1
    reach = [1] * (len(lengths) + 1)  # bit t of reach[i]: lengths[i:] can sum to t
    for i in range(len(lengths) - 1, -1, -1):
        sums, k, rest = reach[i + 1], 1, min(left[lengths[i]], free // lengths[i])
        while rest:
            k = min(k, rest)
            sums |= sums << (k * lengths[i]) & mask
            rest -= k
            k *= 2
        reach[i] = sums

    def exact(i: int, t: int, fill: tuple[int, ...]):
        if t == 0:
            yield fill
            return
        for j in range(i, len(lengths)):
            n = lengths[j]
            for k in range(min(t // n, left[n]), 0, -1):
                if reach[j + 1] >> (t - k * n) & 1:
                    yield from exact(j + 1, t - k * n, fill + (n,) * k)
            if not reach[j + 1] >> t & 1:
                return

    for room in range(min(slack, free) + 1):
        if reach[0] >> (free - room) & 1:
            for fill in exact(0, free - room, ()):
                yield room, fill, left_out((room, fill), left, lengths)


def few_fillings(lengths: list[int], left: dict[int, int], free: int, slack: int, most: int = 64, best: int = 4) -> list[tuple[int, tuple[int, ...], bool]]:
    """The fullest of some fillings, those of the largest lengths, for a quick
    first search that goes back far; fillings() has all."""
    found: list[tuple[int, tuple[int, ...]]] = []
    suffix = [0] * (len(lengths) + 1)
    for i in range(len(lengths) - 1, -1, -1):
        suffix[i] = min(suffix[i + 1] + lengths[i] * left[lengths[i]], 1 << 60)
    budget = [400]

    def grow(i: int, room: int, fill: tuple[int, ...]):
        budget[0] -= 1
        if room == 0 or i == len(lengths):
            if room <= slack:
                found.append((room, fill))
            return
        if budget[0] < 0 or len(found) >= most or room - suffix[i] > slack or (found and found[0][0] == 0 and len(found) >= 8):
            return
        n = lengths[i]
        if n > room:
            # the first length that fits
            lo, hi = i, len(lengths)
            while lo < hi:
                mid = (lo + hi) // 2
                lo, hi = (mid + 1, hi) if lengths[mid] > room else (lo, mid)
            if lo == len(lengths):
                if room <= slack:
                    found.append((room, fill))
                return
            return grow(lo, room, fill)
        for k in range(min(room // n, left[n]), -1, -1):
            grow(i + 1, room - k * n, fill + (n,) * k)

    grow(0, free, ())
    smallest = lengths[-1] if lengths else free + 1
    whole = [x for x in set(found) if x[0] < smallest or left_out(x, left, lengths)]
    return [(*x, True) for x in sorted(whole, key=lambda x: (x[0], tuple(-n for n in x[1])))[:best]]


def left_out(filling: tuple[int, tuple[int, ...]], left: dict[int, int], lengths: list[int]) -> bool:
    """Whether no length that is left still fits the filling's room."""
    room, fill = filling
    used = Counter(fill)
    return not any(n <= room and left[n] > used[n] for n in reversed(lengths[-room:] if room else ()))


def bound(counts: dict[int, int], size: int) -> int:
    """Sequences that any packing needs: by volume, and pieces over a half."""
    return max(-(-sum(n * c for n, c in counts.items()) // size), sum(c for n, c in counts.items() if 2 * n > size))


def solve(counts: dict[int, int], size: int = SIZE, steps: int | None = STEPS) -> Layout:
    """Bin completion over a histogram of lengths from 1 to size."""
    counts = {n: c for n, c in counts.items() if c}
    best = best_fit(counts, size)
    most = sum(t for _, t in best)
    least = bound(counts, size)
    total = sum(n * c for n, c in counts.items())
    steps = float("inf") if steps is None else steps
    left, layout, budget, first, ways_of = {}, [], steps, True, few_fillings

    def descend(made: int, waste: int) -> bool:
        """True when the bound is met and the search is over."""
        nonlocal best, most, budget, first
        # iterative in the common case of one way to go; stack of choices otherwise
        stack = [(iter(choices(waste)), made, waste)]
        while stack:
            ways, made, waste = stack[-1]
            step = next(ways, None)
            budget -= not first
            if budget < 0:
                return True
            if step is None:
                first = False
                stack.pop()
                if stack:
                    undo()
                continue
            fill, times, room = step
            if not times:  # a dominated filling is a step, too
                continue
            apply(fill, times)
            made2, waste2 = made + times, waste + room * times
            if not left:
                first = False
                if made2 < most:
                    best, most = list(layout), made2
                    if most == least:
                        return True
                undo()
            elif -(-(total + waste2) // size) >= most:
                first = False
                undo()  # the waste so far already costs the incumbent's count
            else:
                stack.append((iter(choices(waste2)), made2, waste2))
        return False

    def choices(waste: int):
        n = next(iter(left))
        left[n] -= 1
        usable = [m for m in sorted(left, reverse=True) if left[m] and m <= size - n]
        others = {m: left[m] for m in usable}
        left[n] += 1
        slack = min(size - n, (most - 1) * size - total - waste)
        for room, rest, whole in ways_of(usable, others, size - n, slack) if slack >= 0 else ():
            fill = (n, *rest)
            top = min(left[m] // k for m, k in Counter(fill).items())
            least_times = top - 1 if ways_of is few_fillings else 0
            for times in range(top, least_times, -1) if whole else (0,):
                yield fill, times, room

    def apply(fill, times):
        layout.append((fill, times))
        for m, k in Counter(fill).items():
            left[m] -= k * times
            if not left[m]:
                del left[m]

    def undo():
        fill, times = layout.pop()
        for m, k in Counter(fill).items():
            left[m] = left.get(m, 0) + k * times
        ordered = sorted(left.items(), reverse=True)
        left.clear()
        left.update(ordered)

    for ways_of in (few_fillings, fillings):
        if counts and most > least:
            left, layout = dict(sorted(counts.items(), reverse=True)), []
            budget, first = steps, True
            descend(0, 0)
    return best


def slots(layout: Layout) -> list[tuple[int, int, int, int, int]]:
    """(length, first, last, sequence of first, offset): the pieces of a length
    numbered first..last each take the offset in a sequence of their own."""
    out, done, sequence = [], Counter(), 0
    for fill, times in layout:
        offset = 0
        for n in fill:
            out.append((n, done[n], done[n] + times - 1, sequence, offset))
            done[n] += times
            offset += n
        sequence += times
    return out


def pack(pieces: DataFrame, size: int = SIZE, steps: int | None = STEPS, group: int = GROUP) -> DataFrame:
    """pieces (length, and any other columns) with sequence_id and offset."""
    spark = pieces.sparkSession
    own = pieces.columns
    # at most `size` rows, whatever the corpus
    counts = {n: c for n, c in pieces.groupBy("length").count().collect()}
    slot = spark.createDataFrame(slots(solve(counts, size, steps)), "length long, first long, last long, sequence long, offset long")
    by_length = slot.groupBy("length").agg(F.sort_array(F.collect_list(F.struct("first", "last", "sequence", "offset"))).alias("slots"))
    groups = spark.createDataFrame([(n, -(-c // group)) for n, c in counts.items()], "length long, salts long")
    cells = pieces.select(F.struct(*own).alias("row"), "length", F.xxhash64("doc_id", "piece", "ids_crc32").alias("hash")).join(F.broadcast(groups), "length")
    cells = cells.withColumn("salt", F.pmod("hash", "salts"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    firsts = cells.groupBy("length", "salt").count().select("length", "salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("length", "salt").orderBy("row.doc_id", "row.piece", "row.ids_crc32")
    numbered = cells.withColumn("inside", F.row_number().over(inside) - 1).join(firsts, ["length", "salt"]).withColumn("number", F.col("inside") + F.col("before"))
    # a row for each of at most `size` lengths
    found = numbered.join(F.broadcast(by_length), "length").withColumn("slot", F.element_at(F.filter("slots", lambda s: (s["first"] <= F.col("number")) & (F.col("number") <= s["last"])), 1))
    return found.select(*(F.col("row")[c].alias(c) for c in own), (F.col("slot.sequence") + F.col("number") - F.col("slot.first")).alias("sequence_id"), F.col("slot.offset").alias("offset"))


def best_fit_packing(docs: DataFrame, ranks_path: str | None = None, size: int = SIZE, steps: int | None = STEPS) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset)."""
    return pack(written(token_pieces(docs, ranks_path or vocabulary("byte_bpe_50k.tiktoken"), size), "pieces"), size, steps)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_packing(table(spark, sf_dir, "documents"))
