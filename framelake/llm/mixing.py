"""Mixing sources to target weights by balanced sampling (the cube method).

A source whose target is m times its size gives floor(m) copies of each document and one more of a random
sample whose inclusion probability is m - floor(m). The sample is balanced: the flight phase moves the
fractional probabilities along the null space of two constraints, the words and the number of documents taken,
until each is 0 or 1 but for at most two. Documents fly from the longest to the shortest, so what is left are short ones; of
their four endings, that with the words nearest to the target is taken, and a few taken documents are exchanged for
ones left out where that comes nearer.

Flights run in blocks of bounded size within a source, in parallel; what stays fractional in the blocks meets
in blocks of the next level until one block of each source is left. The moves depend on the blocks' rows and a
seed only, so reruns agree.

Null texts have size 0; a null source is a source, last in order; repeated rows are sampled one by one; an
empty table gives an empty result. Other columns of the input are ignored.
"""

from __future__ import annotations

from bisect import bisect_left
from functools import reduce
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framelake.llm.rows import joined_back, unused
from framelake.session import staged

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
SHARE, MOST = 1.5, 2
BLOCK_ROWS = 4096
SEED = 20_240_607
EXCHANGES = 8
_NEAR = 1e-9


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """source, source_size, target of each source.

    Sources above most times their size stop there and the others share what is left by weight. The stopped are
    those with the least size for their weight, so the right number of them is found in that order. The window
    without partition runs over one row for each source.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    nth = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    per = per.withColumn("weight", F.get(F.array(*map(F.lit, weights)), F.pmod(nth, F.lit(len(weights)))).cast("double"))
    per = per.withColumn("cap", F.col("source_size") * float(most)).withColumn("ratio", F.col("cap") / F.col("weight"))
    order = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    every = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(every) * share - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    heavy = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    per = per.withColumn("level", left / heavy).withColumn("level", F.first(F.when(F.col("level") <= F.col("ratio"), F.col("level")), ignorenulls=True).over(every))
    target = F.when(F.col("ratio") <= F.coalesce("level", "ratio"), F.col("cap")).otherwise(F.col("level") * F.col("weight"))
    return per.select("source", "source_size", target.alias("target"))


def _flight(p: np.ndarray, size: np.ndarray, rng: np.random.Generator, last: bool) -> np.ndarray:
    """p after the flight phase over (size, 1); on the last level also after landing."""
    p, size = p.tolist(), size.tolist()
    words = sum(x * s for x, s in zip(p, size, strict=True))
    toss = iter(rng.random(4 * len(p) + 8).tolist())
    held: list[int] = []

    def move(units: list[int], u: list[float]) -> None:
        up = min((1 - p[i]) / x if x > 0 else p[i] / -x for i, x in zip(units, u, strict=True) if x)
        down = min(p[i] / x if x > 0 else (1 - p[i]) / -x for i, x in zip(units, u, strict=True) if x)
        step = up if next(toss) * (up + down) < down else -down
        for i, x in zip(units, u, strict=True):
            v = p[i] + step * x
            p[i] = 0.0 if v < _NEAR else 1.0 if v > 1 - _NEAR else v
        held[:] = [i for i in held if 0 < p[i] < 1]

    for i in range(len(p)):
        if 0 < p[i] < 1:
            held.append(i)
            while len(held) == 3:
                a, b, c = (size[j] for j in held)
                u = [b - c, c - a, a - b]
                move(list(held), u if any(u) else [1.0, -1.0, 0.0])
    if last and held:
        ends = product((0.0, 1.0), repeat=len(held))
        best = min(ends, key=lambda e: (abs(sum((x - p[i]) * size[i] for i, x in zip(held, e, strict=True))), abs(sum(x - p[i] for i, x in zip(held, e, strict=True)))))
        for i, x in zip(held, best, strict=True):
            p[i] = x
        p = _landed(p, size, sum(x * s for x, s in zip(p, size, strict=True)) - words)
    return np.array(p)


def _landed(p: list[float], size: list[float], excess: float) -> list[float]:
    """p with a few documents exchanged, or else taken or left alone, so that the words come near the target.

    Where a source takes or leaves few documents, exchanges alone can stay far off, as can single steps: three of 50 words
    may have to stand for one of 300. So from over half a word on, filling up from below and from above is tried as well.
    """
    ends = [_exchange(p, size, excess)]
    if abs(ends[0][1]) > 0.5:
        ends.append(_exchange(*_filled(p, size, excess)))
        q, _, rest = _filled([1 - x for x in p], size, -excess)
        ends.append(_exchange([1 - x for x in q], size, -rest))
    return min(ends, key=lambda end: abs(end[1]))[0]


def _filled(p: list[float], size: list[float], excess: float) -> tuple[list[float], list[float], float]:
    """Leave taken documents until the words are no more than the target, then take left ones, the longest first, as they fit."""
    p, order = list(p), sorted(range(len(p)), key=lambda i: (-size[i], i))
    while excess > 0 and (own := [i for i in order if p[i] == 1 and size[i] > 0]):
        i = next((i for i in reversed(own) if size[i] >= excess), own[0])
        p[i], excess = 0.0, excess - size[i]
    for i in order:
        if p[i] == 0 and 0 < size[i] <= -excess:
            p[i], excess = 1.0, excess + size[i]
    return p, size, excess


def _exchange(p: list[float], size: list[float], excess: float) -> tuple[list[float], float]:
    """p and its excess after swaps of a taken and a left document, or single ones taken or left, while that comes nearer."""
    p, none = list(p), (0.0, -1)
    for _ in range(EXCHANGES):
        own = list(enumerate(zip(p, size, strict=True)))
        out = sorted([none, *((s, i) for i, (x, s) in own if x == 0)])
        sizes, best = [s for s, _ in out], (abs(excess), 0, -1, -1)
        for s, i in [none, *((s, i) for i, (x, s) in own if x == 1)]:
            at = bisect_left(sizes, s - excess)
            best = min([best, *((abs(excess - s + sizes[k]), (i < 0) + (out[k][1] < 0), i, out[k][1]) for k in (at - 1, at) if 0 <= k < len(out))])
        left, taken = best[2:]
        if left < 0 and taken < 0:
            break
        if left >= 0:
            p[left], excess = 0.0, excess - size[left]
        if taken >= 0:
            p[taken], excess = 1.0, excess + size[taken]
    return p, excess


def _flown(blocks: DataFrame, level: int, last: bool) -> DataFrame:
    def fly(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "mark", "doc_id"], ascending=[False, True, True], kind="stable", na_position="last")
        rng = np.random.default_rng([SEED, level, abs(int(pdf["src"].iloc[0])), int(pdf["block"].iloc[0])])
        return pdf.assign(p=_flight(pdf["p"].to_numpy(), pdf["size"].to_numpy(np.float64), rng, last))

    return blocks.groupBy("src", "block").applyInPandas(fly, blocks.schema)


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """doc_id, source, size, source_size, target, mark, copies, taken (copies x size) of each row of docs."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    sized = docs.select("doc_id", F.col("source").cast("string").alias("source"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), F.xxhash64("doc_id", text).alias("mark"))
    sized = staged(sized, "sizes")
    goal = staged(targets(sized, weights, share, most), "targets")
    times = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(most)))).otherwise(0.0)
    rows = sized.join(goal, sized.source.eqNullSafe(goal.source)).drop(goal.source).withColumn("m", times)
    rows = rows.withColumn("whole", F.floor(F.col("m") + _NEAR).cast("long")).withColumn("p", F.greatest(F.col("m") - F.col("whole"), F.lit(0.0))).drop("m")
    still = F.col("p") <= _NEAR
    parts, moving, level = [rows.where(still).withColumn("p", F.lit(0.0))], rows.where(~still), 0
    moving = moving.withColumn("src", F.xxhash64("source"))
    while True:
        per = moving.groupBy("src").agg(F.ceil(F.count("*") / BLOCK_ROWS).alias("blocks"))
        blocks = per.agg(F.max("blocks")).first()[0]
        if blocks is None:
            break
        block = F.pmod(F.xxhash64("mark", F.lit(level)), F.col("blocks"))
        flown = staged(_flown(moving.join(per, "src").withColumn("block", block).drop("blocks"), level, blocks == 1), "flown")
        parts.append(flown.where("p = 0 OR p = 1").drop("src", "block"))
        moving, level = flown.where("p > 0 AND p < 1").drop("block"), level + 1
        if blocks == 1:
            break
    copies = F.col("whole") + F.col("p").cast("long")
    placed = reduce(DataFrame.unionByName, parts)
    return placed.select("doc_id", "source", "size", "source_size", "target", "mark", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def mix(docs: DataFrame, **how) -> DataFrame:
    """docs with each row as often as the mix takes it. Columns are those of docs."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    taken = mixed(docs, **how).where("copies > 0")
    kept = joined_back(docs, taken, {"doc_id": F.col("doc_id"), "source": F.col("source").cast("string"), "mark": F.xxhash64("doc_id", text)}, {"copies": (times := unused(docs, "copies"))})
    return kept.withColumn(unused(kept, "copy"), F.explode(F.sequence(F.lit(1), F.col(times).cast("int")))).select(*(F.col(f"`{c}`") for c in docs.columns))
