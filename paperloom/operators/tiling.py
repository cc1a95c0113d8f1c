"""Pages whose reply is cut off, read again in overlapping tiles.

The pages and tiles still to be read are a frontier. Each round calls the model
for all of it at once; a row whose reply was cut off becomes its two halves, which
are the next frontier, `levels` times at most. What was read is folded back level
by level: the tiles of one parent are merged in order, then the parents with their
neighbours. Pixels are the caller's: a Tiler says how high an image is, where it
may be cut, and cuts it.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.calls import FINISHED, OTHER, TRUNCATED, Outcome, attempted
from ..sources.provider import Provider
from . import vision

#: The overlap of halves, the height that isn't cut further, how often a page is halved.
OVERLAP, LEAST_HEIGHT, LEVELS = 0.25, 800, vision.LEAVES.bit_length() - 1
#: Bytes of images that a task of calls reads in one turn. More images are more turns, not larger tasks.
TASK_BYTES = 1 << 27
SPLIT = "split"
READ = "paper_id string, page int, tile string, outcome string, reply string, error string, calls int, content binary"
COLUMNS = ["paper_id", "page", "tile", "outcome", "reply", "error", "calls", "content"]


class Tiler(Protocol):
    def height(self, image: bytes) -> int: ...
    def split_row(self, image: bytes) -> int: ...
    def crop(self, image: bytes, top: int, bottom: int) -> bytes: ...


class LineTiler:
    """Tiles of pages that are texts: a row is a line, cut in the middle."""

    def height(self, image: bytes) -> int:
        return image.count(b"\n") + 1

    def split_row(self, image: bytes) -> int:
        return self.height(image) // 2

    def crop(self, image: bytes, top: int, bottom: int) -> bytes:
        return b"\n".join(image.split(b"\n")[top:bottom])


def read_pages(images: DataFrame, provider: Provider, cut: Callable[[DataFrame], DataFrame], tiler: Tiler | None = None, concurrency: int = 8, levels: int = LEVELS, least_height: int = LEAST_HEIGHT, overlap: float = OVERLAP, attempts: int = 2, pause: float = 1.0, task_bytes: int = TASK_BYTES) -> DataFrame:
    """(paper_id, page, tile, outcome, reply, error, calls) of images (paper_id,
    page, content): the replies that no more reading makes whole. tile is the way
    of halves, '' for a page. At most `concurrency` calls are made at once, and
    each is written before the next round, so that none is made again. Images go in
    turns of about `task_bytes` for each of these tasks, one turn after another."""

    def halves(paper, page, tile, content, calls):
        height = tiler.height(content)
        if height < least_height:
            return None
        row, over = tiler.split_row(content), int(height * overlap)
        parts = tiler.crop(content, 0, min(row + over, height)), tiler.crop(content, max(row - over, 0), height)
        return [(paper, page, tile + str(k), SPLIT, None, None, calls if k == 0 else 0, part) for k, part in enumerate(parts)]

    def one(paper, page, tile, content):
        try:
            if page is None or page != page or page < 1:
                raise ValueError(f"{page} is no page")
            said = attempted(lambda: provider.read_image(bytes(content), int(page)), attempts, pause)
            if said.outcome == TRUNCATED and tiler is not None and len(tile) < levels:
                found = halves(paper, page, tile, bytes(content), said.calls)
                if found:
                    return found
        except Exception as e:  # an image's failure is its own
            said = Outcome(OTHER, None, str(e) or type(e).__name__, 0)
        return [(paper, page, tile, *said, None)]

    def run(batches):
        for rows in batches:
            out = [x for r in zip(rows["paper_id"], rows["page"], rows["tile"], rows["content"]) for x in one(*r)]
            yield pd.DataFrame(out, columns=COLUMNS).astype({"page": "Int32", "calls": "Int32"})

    done, turns = [], in_turns(images.select("paper_id", "page", "content"), concurrency, task_bytes, cut)
    for turn in turns:
        frontier = turn.select("paper_id", "page", F.lit("").alias("tile"), "content")
        for _ in range(levels + 1 if tiler is not None else 1):
            said = cut(frontier.repartition(concurrency, "paper_id", "page", "tile").mapInPandas(run, READ))
            done.append(said.where(F.col("outcome") != SPLIT).drop("content"))
            frontier = said.where(F.col("outcome") == SPLIT).select("paper_id", "page", "tile", "content")
    reads = reduce(DataFrame.unionByName, done)
    return reads if len(turns) == 1 else cut(reads)  # one table, however many turns


def in_turns(images: DataFrame, concurrency: int, task_bytes: int, cut: Callable[[DataFrame], DataFrame]) -> list[DataFrame]:
    """images in parts of about concurrency times task_bytes. If there are several,
    they are written once, a place in a turn to a file, so that a turn reads its own."""
    turns = -(-(images.agg(F.sum(F.length("content"))).first()[0] or 0) // (concurrency * task_bytes))
    if turns <= 1:
        return [images]
    places = turns * concurrency
    held = cut(images.withColumn("place", F.pmod(F.xxhash64("paper_id", "page"), F.lit(places)).cast("int")).repartitionById(places, "place"))
    return [held.where(F.col("place").between(k * concurrency, (k + 1) * concurrency - 1)).drop("place") for k in range(turns)]


def folded(items: DataFrame, levels: int = LEVELS) -> DataFrame:
    """Items of pages, without tile, of items (paper_id, page, tile, idx, ...)
    in their reading order: the tiles of a parent merged, parents with their
    neighbours, up to the page. Pages read whole stay as they are."""
    keys, rest = ("paper_id", "page", "tile"), items
    for level in range(levels, 0, -1):
        deep = F.length("tile") == level
        upper = F.substring("tile", level, 1) == "0"
        # the upper tile is merged in itself before the lower one's items come to it
        pairs = vision.merge_tiles(rest.where(deep & upper), keys).unionByName(rest.where(deep & ~upper))
        merged = vision.merge_tiles(pairs.withColumn("tile", F.substring("tile", 1, level - 1)), keys)
        rest = rest.where(~deep).unionByName(merged)
    return rest.drop("tile")


def whole_pages(reads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(replies of pages that were read whole; (paper_id, page, error) of the
    others: a page of which a tile failed is no page)."""
    bad = reads.where(F.col("outcome") != FINISHED).groupBy("paper_id", "page").agg(F.min_by(F.concat_ws(": ", "outcome", "error"), "tile").alias("error"))
    # null-safe: a page without a number is no page, and has its error
    good = reads.where(F.col("outcome") == FINISHED)
    failed = bad.select(F.col("paper_id").alias("p"), F.col("page").alias("g"))
    good = good.join(failed, F.col("paper_id").eqNullSafe(F.col("p")) & F.col("page").eqNullSafe(F.col("g")), "left_anti")
    return good.select("paper_id", "page", "tile", "reply"), bad


def split_rows(raster: DataFrame, radius: int = 120, share: float = 0.25) -> DataFrame:
    """(page, height, split) of raster (page, y, darkness), a row for each line of
    pixels from 0 on: the row to cut at. Of the rows within `radius` of the middle
    it is a light one (at most `share` of their mean darkness, 1 at least) if there
    is one, the nearest to the middle, and the lower of two as near."""
    page = Window.partitionBy("page")
    sized = raster.select("page", "y", "darkness", F.count("*").over(page).cast("int").alias("height"))
    middle = F.floor(F.col("height") / 2)
    band = sized.where((F.col("y") >= F.greatest(F.lit(0), middle - radius)) & (F.col("y") <= F.least(F.col("height") - 1, middle + radius)))
    lit = band.withColumn("threshold", F.greatest(F.avg("darkness").over(page) * share, F.lit(1.0)))
    best = F.min(F.struct((F.col("darkness") > F.col("threshold")).alias("dark"), F.abs(F.col("y") - middle).alias("away"), (-F.col("y")).alias("up")))
    return lit.groupBy("page", "height").agg(best.alias("b")).select("page", "height", (-F.col("b.up")).cast("int").alias("split"))
