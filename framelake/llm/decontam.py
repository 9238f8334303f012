"""Benchmark passages in documents: q-gram lemma filtering and banded alignment.

Texts are compared in lower case (ASCII and Latin-1 letters) with every run of other ASCII characters as one
blank. An item of m characters is found where a region of the document is within k = edits(m) edits of it. Such
a region shares at least m - Q + 1 - k Q q-grams with the item, on diagonals (document place minus item place)
that lie within k of each other. Shared q-grams are counted in diagonal bands of 2 (k + 1) that overlap by half,
so one band holds them all; bands that reach the bound are verified by banded alignment.

The items' q-gram index goes to the executors in pieces of at most INDEX_CHARS characters of items, one pass
over the documents for each, so what is broadcast is bounded however large the benchmark is. Documents are searched in
slices of SEARCHED_BYTES, as a search needs some fifty times its slice. decontaminated() drops rows where they lie if the
index is one piece; what several pieces find meets the documents in a join.

Items of fewer than Q characters after folding have no q-gram and no edits to spare: they are found exactly, as whole
words. Null texts are empty; items without a letter or digit are not looked for; equal items are found under each of
their ids, repeated documents each; an empty table of either kind gives an empty result; other columns of either
table are ignored, whatever their names.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.llm.arrowtext import buffers, folded, slices
from framelake.llm.rows import unused

Q = 10
EDIT_SHARE = 0.08
INDEX_CHARS = 4 << 20
#: Text bytes searched at once.
SEARCHED_BYTES = 1 << 20
_TABLE_BITS = 22
_MIX = np.uint64(0x9E3779B97F4A7C15)


def edits(m: int) -> int:
    """The edit budget of an item of m characters: EDIT_SHARE of it, as far as the q-gram bound stays positive."""
    return max(0, min(int(EDIT_SHARE * m), (m - Q) // Q))


def squeezed(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, row offsets, place of each byte in data): folded rows with single blanks, none at a row's start."""
    data = folded(data)
    keep = np.ones(len(data), bool)
    blank = data == 0x20
    keep[1:] = ~(blank[1:] & blank[:-1])
    begin = at[:-1][at[1:] > at[:-1]]
    keep[begin] = ~blank[begin]
    before = np.concatenate([[0], np.cumsum(keep)])
    return data[keep], before[at], np.flatnonzero(keep)


def _codes(data: np.ndarray) -> np.ndarray:
    """A hash of the Q bytes from each place on: eight of them as a number, mixed with the last eight."""
    n = len(data) - Q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    eight = np.ndarray((len(data) - 7,), np.uint64, np.ascontiguousarray(data), strides=(1,))
    return eight[:n] * _MIX ^ eight[Q - 8 :]


class Index:
    """The q-grams of a set of items: code -> (item, place), with a bitmap to pass over other codes quickly."""

    def __init__(self, ids: list[int], texts: list[str]):
        data, at, _ = squeezed(*buffers(pa.array(texts, pa.string())))
        rows = [data[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
        rows = [r[:-1] if len(r) and r[-1] == 0x20 else r for r in rows]
        self.short: dict[int, dict[bytes, list[int]]] = {}
        for i, r in zip(ids, rows, strict=True):
            if 0 < len(r) < Q:
                self.short.setdefault(len(r), {}).setdefault(r.tobytes(), []).append(i)
        kept = [(i, r) for i, r in zip(ids, rows, strict=True) if len(r) >= Q]
        self.ids, self.items = [i for i, _ in kept], [r for _, r in kept]
        self.size = np.array([len(r) for r in self.items], np.int64)
        self.budget = np.array([edits(len(r)) for r in self.items], np.int64)
        self.bound = self.size - Q + 1 - self.budget * Q
        #: The items of fewer than Q characters come after the others.
        self.ids += [i for by in self.short.values() for own in by.values() for i in own]
        self.reach = int(self.size.max()) if len(self.size) else 0
        codes = [_codes(r) for r in self.items]
        self.codes = np.concatenate(codes) if codes else np.zeros(0, np.uint64)
        self.item = np.repeat(np.arange(len(codes)), [len(c) for c in codes]).astype(np.int64)
        self.place = np.concatenate([np.arange(len(c)) for c in codes]) if codes else np.zeros(0, np.int64)
        order = np.argsort(self.codes, kind="stable")
        self.codes, self.item, self.place = self.codes[order], self.item[order], self.place[order]
        self.filter = np.zeros(1 << _TABLE_BITS, bool)
        self.filter[self._slot(self.codes)] = True

    @staticmethod
    def _slot(codes: np.ndarray) -> np.ndarray:
        return ((codes * _MIX) >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)

    def find(self, data: np.ndarray, at: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """(row, item, start, end, edits) of the items in squeezed rows; places are within data."""
        exact, codes = self._exact(data, at), _codes(data)
        if not len(codes) or not len(self.codes):
            return exact
        hit = np.flatnonzero(self.filter[self._slot(codes)])
        lo = np.searchsorted(self.codes, codes[hit], side="left")
        count = np.searchsorted(self.codes, codes[hit], side="right") - lo
        hit, lo, count = hit[count > 0], lo[count > 0], count[count > 0]
        row = np.searchsorted(at, hit, side="right") - 1
        inside = hit + Q <= at[row + 1]
        hit, lo, count = hit[inside], lo[inside], count[inside]
        which = np.repeat(lo, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        item, pos = self.item[which], np.repeat(hit, count)
        start = pos - self.place[which]  # the diagonal, as a place in data: it tells the row but at a row's border
        half = self.budget[item] + 1
        # bands start at multiples of half and are twice as wide; a band is named by item and its number
        band = (start + self.reach) // half
        span = np.int64(len(data) + self.reach + 2)
        band += 1  # so that the one before the first has a number too
        keys = np.concatenate([item * span + band, item * span + band - 1])
        keys, n = np.unique(keys, return_counts=True)
        item = keys // span
        keep = n >= self.bound[item]
        found = []
        for it, b in zip(item[keep].tolist(), (keys[keep] % span).tolist(), strict=True):
            k = int(self.budget[it])
            first = (b - 1) * (k + 1) - self.reach
            found += self._verified(data, at, it, first - k, first + 2 * (k + 1) + k)
        return exact + _apart(found)

    def _exact(self, data: np.ndarray, at: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """The items without a q-gram, where they stand as whole words."""
        found, item = [], len(self.items)
        edge = np.ones(len(data) + 1, bool)
        edge[1:-1] = (data[1:] == 0x20) | (data[:-1] == 0x20)
        edge[at] = True
        for n, by in self.short.items():
            number = {}
            for text, ids in by.items():
                number[text] = range(item, item + len(ids))
                item += len(ids)
            if len(data) < n:
                continue
            head = {t[0] for t in by}
            first = np.zeros(256, bool)
            first[list(head)] = True
            for p in np.flatnonzero(edge[: len(data) - n + 1] & edge[n:] & first[data[: len(data) - n + 1]]).tolist():
                row = int(np.searchsorted(at, p, side="right")) - 1
                if p + n <= at[row + 1]:
                    found += [(row, k, p, p + n, 0) for k in number.get(data[p : p + n].tobytes(), ())]
        return found

    def _verified(self, data: np.ndarray, at: np.ndarray, it: int, lo: int, hi: int) -> list[tuple[int, int, int, int, int]]:
        """The best region of each row among those that lie on diagonals lo .. hi - 1."""
        m, k, out = int(self.size[it]), int(self.budget[it]), []
        a, b = max(lo, 0), min(hi + m, len(data))
        for row in range(int(np.searchsorted(at, a, side="right")) - 1, int(np.searchsorted(at, max(a, b - 1), side="right"))):
            s, e = max(a, int(at[row])), min(b, int(at[row + 1]))
            if e - s >= m - k:
                best = aligned(self.items[it], data[s:e], k, lo - s, hi - s)
                if best is not None:
                    out.append((row, it, s + best[0], s + best[1], best[2]))
        return out


def _apart(found: list[tuple[int, int, int, int, int]]) -> list[tuple[int, int, int, int, int]]:
    """Of regions of one item and row that overlap, the one with the fewest edits."""
    kept: dict[tuple[int, int], list[tuple[int, int, int]]] = {}
    for row, item, start, end, edits_ in sorted(set(found), key=lambda x: (x[4], x[2], x[3])):
        own = kept.setdefault((row, item), [])  # in order, no two of them overlap
        i = bisect_left(own, (start, end))
        if not (i and own[i - 1][1] > start) and not (i < len(own) and own[i][0] < end):
            own.insert(i, (start, end, edits_))
    return [(row, item, *x) for (row, item), own in kept.items() for x in own]


def aligned(item: np.ndarray, text: np.ndarray, k: int, lo: int | None = None, hi: int | None = None) -> tuple[int, int, int] | None:
    """(start, end, edits) of the region of text nearest to item, if it is within k edits and on diagonals lo .. hi - 1."""
    lo, hi = (-k if lo is None else lo), (len(text) - len(item) + k + 1 if hi is None else hi)
    row = _banded(item, text, lo, hi, k, free=True)
    if row is None or row.min() > k:
        return None
    end = len(item) + lo + int(row.argmin())
    back = _banded(item[::-1], text[:end][::-1], -k, k + 1, k, free=False)
    return end - (len(item) - k + int(back.argmin())), end, int(row.min())


def _banded(item: np.ndarray, text: np.ndarray, lo: int, hi: int, k: int, free: bool) -> np.ndarray | None:
    """Edits from item to the best stretch of text that ends on each of the diagonals lo .. hi - 1; None if all exceed k.

    The stretch begins on any of them if free, else at 0. A row of the table has one number for each diagonal; the
    band moves on by one place in text with each character of item.
    """
    n, width, far = len(text), hi - lo, np.int32(1 << 29)
    padded = np.full(n + 2 * (width + len(item)) + 2, -1, np.int16)
    shift = width + len(item) + 1
    padded[shift : shift + n] = text
    ends = lo + np.arange(width)
    steps = np.arange(width, dtype=np.int32)
    row = np.where((ends >= 0) & (ends <= n), 0 if free else ends, far).astype(np.int32)
    new, differs = np.empty(width, np.int32), np.empty(width, bool)
    for i, c in enumerate(item.tolist(), 1):
        at = shift + i - 1 + lo
        if at < 0 or at + width > len(padded):
            return None
        np.not_equal(padded[at : at + width], c, out=differs)
        np.add(row, differs, out=new)
        np.minimum(new[:-1], row[1:] + 1, out=new[:-1])
        first, last = max(0, -(i + lo)), max(0, n + 1 - i - lo)  # diagonals that end inside text
        new[:first] = far
        new[last:] = far
        new -= steps
        np.minimum.accumulate(new, out=new)
        new += steps
        new[last:] = far
        row, new = new, row
        if i % 64 == 0 and row.min() > k:
            return None
    return row


def _indexes(benchmark: DataFrame) -> Iterator[Index]:
    """Indexes over the items, each of at most INDEX_CHARS characters or of one item."""
    ids, texts, size = [], [], 0
    for r in benchmark.select("item_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).orderBy("item_id", "text").toLocalIterator():
        if ids and size + len(r.text) > INDEX_CHARS:
            yield Index(ids, texts)
            ids, texts, size = [], [], 0
        ids.append(r.item_id)
        texts.append(r.text)
        size += len(r.text)
    if ids:
        yield Index(ids, texts)


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, start, end (bytes of the document's text), edits: every item found in every row of docs."""
    spark = docs.sparkSession
    read = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.xxhash64("doc_id", F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("mark"))
    kinds = {c: t.dataType.simpleString() for c, t in [("doc_id", docs.schema["doc_id"]), ("item_id", benchmark.schema["item_id"])]}
    schema = f"doc_id {kinds['doc_id']}, item_id {kinds['item_id']}, start long, end long, edits long, mark long"

    def search(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch in slices(batches, limit=SEARCHED_BYTES):
                data, at, places = squeezed(*(raw := buffers(batch.column("text"))))
                found = index.find(data, at)
                rows = pa.array([x[0] for x in found], pa.int64())
                base = raw[1]
                start = [int(places[x[2]] - base[x[0]]) for x in found]
                end = [int(places[x[3] - 1] + 1 - base[x[0]]) for x in found]
                ids = pa.array([index.ids[x[1]] for x in found], {"bigint": pa.int64(), "int": pa.int32()}.get(kinds["item_id"], pa.string()))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(rows), ids, pa.array(start, pa.int64()), pa.array(end, pa.int64()), pa.array([x[4] for x in found], pa.int64()), batch.column("mark").take(rows)], ["doc_id", "item_id", "start", "end", "edits", "mark"])

        return run

    parts = [read.mapInArrow(search(spark.sparkContext.broadcast(index)), schema) for index in _indexes(benchmark)]
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], schema)


def _holds(spark: SparkSession, index: Index) -> Callable[[Column], Column]:
    """Whether a text holds an item of index."""
    shared = spark.sparkContext.broadcast(index)

    @F.arrow_udf("boolean")
    def holds(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            found = [np.zeros(0, bool)]
            for batch in slices(iter([pa.RecordBatch.from_arrays([column], ["text"])]), limit=SEARCHED_BYTES):
                data, at, _ = squeezed(*buffers(batch.column("text")))
                hit = np.zeros(batch.num_rows, bool)
                hit[[x[0] for x in shared.value.find(data, at)]] = True
                found.append(hit)
            yield pa.array(np.concatenate(found))

    return holds


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the rows in which a benchmark item was found."""
    indexes = _indexes(benchmark)
    index, more = next(indexes, None), next(indexes, None)
    if index is None:
        return docs
    if more is None:
        return docs.where(~_holds(docs.sparkSession, index)(F.col("text").cast("string")))
    mark = F.xxhash64("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")))
    own = unused(docs, "mark")
    bad = contaminated(docs, benchmark).select(F.col("mark").alias(own)).distinct()
    return docs.withColumn(own, mark).join(bad, own, "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))
