"""Exact top-k by inner product over a bit-sliced index.

Every component is quantised to an integer and the integers of one dimension are kept as bit slices: bitmaps
over the rows of a block, one for each binary digit. The score of a query is a weighted sum of dimensions,
which carry-save addition of the bitmaps computes for all rows of the block at once. The top rows are then
read off the score's slices from the most significant one downward; the rows on the boundary share one score,
and the smallest ids among them fill the last places.

Rows meet queries in blocks: each block of rows is one row of the index table, and each block of queries is
dealt to every block of rows by an equi-join. Vectors that are null or hold null or non-finite components take
no part; components missing from a shorter vector count as 0; repeated ids are all candidates, except for
queries of that id; a query with no other row gets no result. An empty table gives an empty result, and other columns
are ignored. Components beyond a long are taken as the greatest or smallest one. Where a query's scores might leave the
range of a long, its block is ranked by exact Python integers, and scores beyond a long are given as the greatest or
smallest one, which ranks them as equal to each other across blocks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framelake.session import staged

SCALE = 1024
ROWS, QUERIES = 16_384, 256


def quantised(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, x: floor(SCALE * component) as longs."""
    v = F.col(vector_col)
    finite = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf")))
    kept = vectors.where(v.isNotNull() & F.col(id_col).isNotNull() & finite)
    return kept.select(F.col(id_col).cast("long").alias("vec_id"), F.transform(v, lambda c: F.floor(F.lit(float(SCALE)) * c.cast("double"))).alias("x"))


def _matrix(rows: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(rows), width), np.int64)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def _packed(bits: np.ndarray) -> np.ndarray:
    """Rows of 0/1 bytes as rows of 64-bit words."""
    pad = -bits.shape[-1] % 64
    return np.packbits(np.pad(bits, [(0, 0)] * (bits.ndim - 1) + [(0, pad)]), axis=-1, bitorder="little").view(np.uint64)


class BitSlices:
    """The slices of one block: of each dimension, its least value and the binary digits above that."""

    def __init__(self, ids: np.ndarray, least: np.ndarray, digits: np.ndarray, words: np.ndarray):
        self.ids, self.least, self.digits = ids, least, digits
        cut = np.cumsum(digits)[:-1]
        self.slices = np.split(words.reshape(int(digits.sum()), -(-len(ids) // 64)), cut)
        self.all = _packed(np.ones((1, len(ids)), np.uint8))[0]

    @classmethod
    def of(cls, ids: np.ndarray, x: np.ndarray) -> BitSlices:
        order = np.argsort(ids, kind="stable")
        ids, x = ids[order], x[order]
        least = x.min(axis=0)
        above = x.astype(np.uint64) - least.astype(np.uint64)  # right modulo 2**64, also where the difference is no long
        digits = np.array([int(v).bit_length() for v in above.max(axis=0)], np.int64)
        each = [_packed(((above[:, d] >> np.arange(b, dtype=np.uint64)[:, None]) & np.uint64(1)).astype(np.uint8)) for d, b in enumerate(digits) if b]
        return cls(ids, least, digits, np.concatenate(each) if each else np.zeros((0, -(-len(ids) // 64)), np.uint64))

    def stored(self) -> list[bytes]:
        """ids, least, digits and words as bytes, which read() takes."""
        return [x.tobytes() for x in (self.ids, self.least, self.digits, np.concatenate(self.slices))]

    @classmethod
    def read(cls, ids: bytes, least: bytes, digits: bytes, words: bytes) -> BitSlices:
        return cls(*(np.frombuffer(b, t) for b, t in ((ids, np.int64), (least, np.int64), (digits, np.int64), (words, np.uint64))))

    def fits(self, q: np.ndarray) -> bool:
        """Whether all sums on the way to a score of q are sure to be longs."""
        return not sum(abs(int(w)) * (abs(int(a)) + (1 << int(b))) for w, a, b in zip(q, self.least, self.digits, strict=True)) >> 62

    def exact(self, q: list[int]) -> list[int]:
        """The scores of all rows as Python integers, read off the slices."""
        out = [0] * len(self.ids)
        for own, a, w in zip(self.slices, self.least.tolist(), q, strict=True):
            bits = [np.unpackbits(s.view(np.uint8), bitorder="little")[: len(out)] for s in np.ascontiguousarray(own)]
            for i in range(len(out)):
                out[i] += int(w) * (a + sum(1 << b for b, s in enumerate(bits) if s[i]))
        return out

    def scores(self, q: np.ndarray) -> tuple[list[np.ndarray], int]:
        """(slices, offset): a row's score is offset plus its number in the slices, least significant first."""
        columns: dict[int, list[np.ndarray]] = {}
        offset = int(sum(int(a) * int(b) for a, b in zip(q, self.least, strict=True)))
        for d, w in enumerate(map(int, q)):
            if not w or not self.digits[d]:
                continue
            own = self.slices[d]
            if w < 0:  # -|w| y = |w| (m - y) - |w| m, and m - y flips every digit
                own, w = ~own, -w
                offset -= w * ((1 << self.digits[d]) - 1)
            for j in range(w.bit_length()):
                if w >> j & 1:
                    for b in range(self.digits[d]):
                        columns.setdefault(j + b, []).append(own[b])
        out, level = [], 0
        while columns:
            own = columns.pop(level, [])
            stack = np.array(own) if own else np.zeros((1, len(self.all)), np.uint64)
            while len(stack) > 1:  # full adders: three slices of a weight become one of it and one of the next
                m = len(stack) // 3 * 3 if len(stack) > 2 else 0
                if m:
                    a, b, c = stack[0:m:3], stack[1:m:3], stack[2:m:3]
                    half = a ^ b
                    columns.setdefault(level + 1, []).extend((a & b) | (c & half))
                    stack = np.concatenate([half ^ c, stack[m:]])
                else:
                    columns.setdefault(level + 1, []).append(stack[0] & stack[1])
                    stack = (stack[0] ^ stack[1])[None]
            out.append(stack[0])
            level += 1
        return out, offset

    def top(self, q: np.ndarray, k: int, but: int) -> list[tuple[int, int]]:
        """The k best (vec_id, score); rows of id but take no part."""
        if not self.fits(q):
            all_scores = sorted((-s, int(i)) for s, i in zip(self.exact(q.tolist()), self.ids, strict=True) if i != but)
            return [(i, max(-(1 << 63), min(-s, (1 << 63) - 1))) for s, i in all_scores[:k]]
        slices, offset = self.scores(q)
        lo, hi = np.searchsorted(self.ids, [but, but + 1])
        equal = self.all.copy()
        if hi > lo:
            own = np.zeros(len(self.ids), np.uint8)
            own[lo:hi] = 1
            equal &= ~_packed(own[None])[0]
        sure = np.zeros_like(equal)
        for s in reversed(slices):
            more = sure | (equal & s)
            n = int(np.bitwise_count(more).sum())
            if n > k:
                equal &= s
            else:
                sure = more
                equal &= ~s
                if n == k:
                    break
        picked = np.flatnonzero(np.unpackbits(sure.view(np.uint8), bitorder="little"))
        if len(picked) < k:  # rows on the boundary, all of one score
            edge = np.flatnonzero(np.unpackbits(equal.view(np.uint8), bitorder="little"))
            picked = np.concatenate([picked, edge[: k - len(picked)]])
        score = np.full(len(picked), offset, np.int64)
        for level, own in enumerate(slices):
            score += ((own[picked // 64] >> (picked % 64).astype(np.uint64)) & np.uint64(1)).astype(np.int64) << level
        return [(int(self.ids[i]), int(v)) for i, v in zip(picked, score, strict=True)]


def top_k(vectors: DataFrame, is_query: Column, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id, score: of each query row the k other rows of the largest inner product."""
    rows = staged(quantised(vectors), "quantised")
    counted = rows.agg(F.count("*").alias("n"), F.count(F.when(is_query, 1)).alias("q"), F.coalesce(F.max(F.size("x")), F.lit(0)).alias("w")).first()
    blocks, groups, width = max(1, -(-counted.n // ROWS)), max(1, -(-counted.q // QUERIES)), counted.w

    def sliced(pdf: pd.DataFrame) -> pd.DataFrame:
        own = BitSlices.of(pdf["vec_id"].to_numpy(np.int64), _matrix(pdf["x"], width))
        return pd.DataFrame([[int(pdf["block"].iloc[0]), *own.stored()]], columns=["block", "ids", "least", "digits", "words"])

    def gathered(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([[int(pdf["grp"].iloc[0]), pdf["vec_id"].to_numpy(np.int64).tobytes(), _matrix(pdf["x"], width).tobytes()]], columns=["grp", "qids", "q"])

    spread = rows.withColumn("block", F.pmod(F.xxhash64("vec_id", F.col("x")), F.lit(blocks)))
    index = staged(spread.groupBy("block").applyInPandas(sliced, "block long, ids binary, least binary, digits binary, words binary"), "bit-slices")
    asked = rows.where(is_query).dropDuplicates(["vec_id"]).withColumn("grp", F.pmod(F.xxhash64("vec_id"), F.lit(groups)))
    asked = asked.groupBy("grp").applyInPandas(gathered, "grp long, qids binary, q binary")
    pairs = asked.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<long>"))).join(index.hint("shuffle_hash"), "block")

    def searched(pdf: pd.DataFrame) -> pd.DataFrame:
        found = []
        for r in pdf.itertuples():
            queries, slices = np.frombuffer(r.qids, np.int64), BitSlices.read(r.ids, r.least, r.digits, r.words)
            for qid, q in zip(queries, np.frombuffer(r.q, np.int64).reshape(len(queries), width), strict=True):
                found += [(int(qid), v, s) for v, s in slices.top(q, k, int(qid))]
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"]).astype("int64")

    best = pairs.groupBy("block", "grp").applyInPandas(searched, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
