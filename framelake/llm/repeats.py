"""Removal of repeated byte strings with suffix arrays.

A byte is removed where a string of LENGTH bytes that covers it also starts anywhere else, in any document.

Two equal strings must meet in one suffix array, whichever documents hold them, so the arrays are sharded by
content. Each string of LENGTH bytes has an anchor: the GRAM bytes inside it with the least hash (the leftmost
of equals). Strings in a row that share an anchor place form its context, about a gram window long plus LENGTH,
and equal strings have equal anchors. So contexts are grouped by anchor; equal contexts are counted and kept
once; anchors that occur once can hold no repeat. Contexts of an anchor that differ go to the shard of the
anchor, where a suffix array of all contexts is sorted by Larsson-Sadakane refinement, down to LENGTH bytes, and
neighbours' common prefixes are found by Kasai's walk, every context being a lane of its own. A string is
repeated if a neighbour shares LENGTH bytes with it or if its context occurs again.

An anchor with more than HOT different contexts is dealt over several shards. Their strings are then merged
across shards: each shard sorts the digests of its strings, ranges of digests meet in tasks of bounded size, and
binary search finds those of one shard in the lists of the others.

Beside this, a document shares a passage if PASSAGE words in a row, whatever blanks stand between them, also stand
in another document. Most such passages are shorter than LENGTH, so words are anchored too, as a sequence of hashes:
contexts of word anchors that several documents hold whole settle those documents; where an anchor of several
documents has one that is not settled, the digests of its strings of PASSAGE words are compared. Nothing is removed
for it. Rows equal in doc_id and text are one document here.

Null texts are empty; texts shorter than LENGTH keep all; repeated rows are repeats of each other; an empty
table gives an empty result; other columns are ignored. Memory holds one text and one shard at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelake.llm.arrowtext import Rolling, buffers, mixed, packed, slices, words
from framelake.session import staged

LENGTH, GRAM = 400, 100
PASSAGE, WORD_GRAM = 50, 10
HOT = 512
SHARD_BYTES = 2 << 20
_U = np.uint64
_BLANKED = np.arange(256, dtype=np.uint8)
_BLANKED[9:14] = 0x20


def _window_minima(v: np.ndarray, window: int) -> np.ndarray:
    """The minimum of each window consecutive values."""
    n = len(v) - window + 1
    pad = np.full(-(-len(v) // window) * window, np.iinfo(np.uint64).max, np.uint64)
    pad[: len(v)] = v
    blocks = pad.reshape(-1, window)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[window - 1 : window - 1 + n])


def contexts(roll: Rolling, at: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(row, anchor hash, context hash, first start within the row, number of starts) of each context."""
    empty = (np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    if at[-1] < length:
        return empty
    grams = roll.each(gram)
    least = _window_minima((grams & ~_U(0xFFFFFFFF)) | np.arange(len(grams), dtype=np.uint64), length - gram + 1) & _U(0xFFFFFFFF)
    last = np.repeat(at[1:] - length, np.diff(at))[: len(least)]  # the last start of each place's row
    start = np.flatnonzero(np.arange(len(least)) <= last)
    if not len(start):
        return empty
    row = np.searchsorted(at, start, side="right") - 1
    spot = least[start].astype(np.int64)
    new = np.ones(len(start), bool)
    new[1:] = (spot[1:] != spot[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(start)))
    lo, spot, row = start[first], spot[first], row[first]
    own = mixed(roll.of(lo, lo + count - 1 + length) + (spot - lo).astype(np.uint64) * _U(0x9E3779B97F4A7C15) + count.astype(np.uint64))
    return row, mixed(grams[spot] + _U(length)), own, lo - at[row], count


def _word_hashes(data: np.ndarray, at: np.ndarray, roll: Rolling) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, hash) of the words between blanks, and where each row's words begin."""
    start, end, row = words(_BLANKED[data], at)
    return start, end, roll.of(start, end), np.searchsorted(row, np.arange(len(at)))


def word_contexts(data: np.ndarray, at: np.ndarray, roll: Rolling) -> tuple[np.ndarray, ...]:
    """(row, anchor hash, context hash, first byte within the row, number of bytes) of each context of words."""
    start, end, word, begin = _word_hashes(data, at, roll)
    row, f, ctx, lo, count = contexts(Rolling(word), begin, PASSAGE, WORD_GRAM)
    lo = begin[row] + lo
    first = start[lo]
    return row, f, ctx, first - at[row], end[lo + count - 1 + PASSAGE - 1] - first


def suffix_array(text: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, rank) of all suffixes of text, compared up to LENGTH bytes; ends: where each place's context ends."""
    n = len(text)
    places = np.arange(n)
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    key = np.zeros(n, np.uint64)
    for k in range(8):
        key = (key << _U(8)) | np.where(places + k < ends, padded[k : n + k], 0).astype(np.uint64)
    order = np.argsort(key)
    new = np.ones(n, bool)
    new[1:] = key[order[1:]] != key[order[:-1]]
    group = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank = np.zeros(n, np.int64)
    rank[order] = group + 1
    h = 8
    while h < LENGTH:
        single = new & np.append(new[1:], True)
        left = np.flatnonzero(~single)
        if not len(left):
            break
        which = order[left]
        ahead = which + h
        second = np.where(ahead < ends[which], rank[np.minimum(ahead, n - 1)], 0)
        both = (rank[which] << 32) | second
        by = np.argsort(both)
        which, both = which[by], both[by]
        order[left] = which
        fresh = np.ones(len(left), bool)
        fresh[1:] = both[1:] != both[:-1]
        new[left] = fresh | new[left]
        start = np.maximum.accumulate(np.where(fresh, left, 0))
        rank[which] = start + 1
        h *= 2
    return order, rank


def common_prefixes(text: np.ndarray, begin: np.ndarray, size: np.ndarray, order: np.ndarray) -> np.ndarray:
    """For each place, the bytes that its suffix shares with the one before it in order, up to LENGTH.

    Kasai's walk: from a place to the next the shared length falls by one at most. Where two suffixes agreed as
    far as they are compared, order says nothing about those after them, and the length carries over only between
    the same two. Contexts are lanes of their own, all walked at once; bytes are compared eight at a time.
    """
    n = len(text)
    before = np.full(n, -1)
    before[order[1:]] = order[:-1]
    ends = np.repeat(begin + size, size)
    eight = np.ndarray((n,), np.uint64, np.concatenate([text, np.zeros(8, np.uint8)]), strides=(1,))
    out = np.zeros(n, np.int64)
    shared, partner, tied = np.zeros(len(begin), np.int64), np.full(len(begin), -1), np.zeros(len(begin), bool)
    by_size = np.argsort(-size, kind="stable")
    begin, size = begin[by_size], size[by_size]
    for j in range(int(size.max()) if len(size) else 0):
        lanes = int(np.searchsorted(-size, -j, side="left"))  # those longer than j
        i = begin[:lanes] + j
        other = before[i]
        live = np.flatnonzero(other >= 0)
        got = np.maximum(shared[:lanes] - 1, 0)
        got[(other < 0) | (tied[:lanes] & (other != partner[:lanes] + 1))] = 0
        most = np.minimum(np.minimum(ends[i] - i, np.where(other >= 0, ends[other] - other, 0)), LENGTH)
        live = live[got[live] < most[live]]
        while len(live):
            x = eight[i[live] + got[live]] ^ eight[other[live] + got[live]]
            same = np.where(x == 0, 8, _low_zero_bytes(x))
            got[live] = np.minimum(got[live] + same, most[live])
            live = live[(same == 8) & (got[live] < most[live])]
        out[i] = got
        shared[:lanes], partner[:lanes], tied[:lanes] = got, other, got >= most
    return out


def _low_zero_bytes(x: np.ndarray) -> np.ndarray:
    low = x & (~x + _U(1))
    return np.bitwise_count(low - _U(1)).astype(np.int64) // 8


def repeated_starts(pieces: list[bytes]) -> list[np.ndarray]:
    """For each context, the starts whose LENGTH bytes occur elsewhere in the contexts."""
    size = np.array([len(p) for p in pieces], np.int64)
    begin = np.cumsum(size) - size
    text = np.frombuffer(b"".join(pieces), np.uint8)
    ends = np.repeat(begin + size, size)
    order, _ = suffix_array(text, ends)
    shared = common_prefixes(text, begin, size, order)
    hit = shared >= LENGTH
    twice = hit.copy()
    where = np.flatnonzero(hit[order])
    twice[order[where[where > 0] - 1]] = True
    return [np.flatnonzero(twice[b : b + s]) for b, s in zip(begin, size, strict=True)]


def _runs(starts: np.ndarray) -> list[list[int]]:
    """[from, to) of the bytes that the strings at these starts cover."""
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) > LENGTH)
    return [[int(a), int(b) + LENGTH] for a, b in zip(starts[np.concatenate([[0], cut + 1])], starts[np.append(cut, len(starts) - 1)], strict=True)]


def _anchored(docs: DataFrame) -> DataFrame:
    def anchor(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            data, at = buffers(batch.column("text"))
            roll = Rolling(data)
            row, f, ctx, lo, count = contexts(roll, at)
            for of_words, (row, f, ctx, lo, size) in ((False, (row, f, ctx, lo, count - 1 + LENGTH)), (True, word_contexts(data, at, roll))):
                yield pa.RecordBatch.from_arrays([batch.column("mark").take(pa.array(row)), pa.array(f.view(np.int64)), pa.array(ctx.view(np.int64)), pa.array(lo.astype(np.int32)), pa.array(size.astype(np.int32)), pa.array(np.full(len(row), of_words))], ["mark", "f", "ctx", "lo", "size", "words"])

    return docs.select("mark", "text").mapInArrow(anchor, "mark long, f long, ctx long, lo int, size int, words boolean")


def _cut_out(wanted: DataFrame, blobs: DataFrame) -> DataFrame:
    """wanted with the bytes of each context."""
    lists = wanted.groupBy("mark").agg(F.collect_list(F.struct("f", "ctx", "n", "d", "lo", "size", "words")).alias("w"))
    names = ["mark", "f", "ctx", "n", "d", "lo", "words", "bytes"]

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        z = zstandard.ZstdDecompressor()
        for pdf in batches:
            out = []
            for r in pdf.itertuples():
                text = z.decompress(r.blob) if r.blob else b""
                out += [(r.mark, x["f"], x["ctx"], x["n"], x["d"], x["lo"], x["words"], text[x["lo"] : x["lo"] + x["size"]]) for x in r.w]
                if len(out) > 4096:
                    yield pd.DataFrame(out, columns=names)
                    out = []
            yield pd.DataFrame(out, columns=names)

    # rows that repeat as a whole share a mark and would cut the same contexts
    return blobs.join(lists, "mark").mapInPandas(cut, "mark long, f long, ctx long, n long, d long, lo int, words boolean, bytes binary").dropDuplicates(["f", "ctx"])


def _in_shards(found: DataFrame) -> DataFrame:
    """mark, a, b: what suffix arrays find in contexts that occur once."""

    def shard(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        size, last = 0, None

        def done() -> pd.DataFrame:
            rows = pd.concat(held)
            spans = []
            for mark, n, lo, starts in zip(rows["mark"], rows["n"], rows["lo"], repeated_starts(list(rows["bytes"])), strict=True):
                if n == 1:
                    spans += [(mark, lo + a, lo + b) for a, b in _runs(starts)]
            return pd.DataFrame(spans, columns=["mark", "a", "b"]).astype("int64")

        for pdf in batches:
            names = pdf[["f", "sub"]].to_numpy()
            change = np.flatnonzero((names[1:] != names[:-1]).any(axis=1)) + 1
            for part in np.split(np.arange(len(pdf)), change):
                if not len(part):
                    continue
                block = pdf.iloc[part]
                if size >= SHARD_BYTES and tuple(names[part[0]]) != last:
                    yield done()
                    held, size = [], 0
                held.append(block)
                size += int(block["bytes"].map(len).sum())
                last = tuple(names[part[0]])
        if held:
            yield done()

    dealt = found.repartition("f", "sub").sortWithinPartitions("f", "sub")
    return dealt.mapInPandas(shard, "mark long, a long, b long")


def _digests(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context, start, digest) of every string of the contexts."""
    size = np.array([len(p) for p in pieces], np.int64)
    begin, starts = np.cumsum(size) - size, size - LENGTH + 1
    roll = Rolling(np.frombuffer(b"".join(pieces), np.uint8))
    which = np.repeat(np.arange(len(pieces)), starts)
    start = np.arange(len(which)) - np.repeat(np.cumsum(starts) - starts, starts)
    lo = begin[which] + start
    return which, start, roll.of(lo, lo + LENGTH)


def _across_shards(hot: DataFrame) -> DataFrame:
    """mark, a, b: strings of hot anchors that occur in several of its shards."""

    def export(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = int(pdf["parts"].iloc[0])
        digest = np.unique(_digests(list(pdf["bytes"]))[2])
        cut = np.searchsorted(digest, np.array([k * ((1 << 64) // parts) for k in range(1, parts)], np.uint64))
        rows = [(pdf["f"].iloc[0], k, pdf["sub"].iloc[0], x.tobytes()) for k, x in enumerate(np.split(digest, cut)) if len(x)]
        return pd.DataFrame(rows, columns=["f", "r", "sub", "digests"])

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        lists = [np.frombuffer(b, np.uint64) for b in pdf["digests"]]
        every = np.sort(np.concatenate(lists))
        many = np.unique(every[1:][every[1:] == every[:-1]])
        rows = []
        for sub, own in zip(pdf["sub"], lists, strict=True):
            at = np.searchsorted(own, many)
            there = many[(at < len(own)) & (own[np.minimum(at, len(own) - 1)] == many)] if len(own) else many[:0]
            if len(there):
                rows.append((pdf["f"].iloc[0], sub, there.tobytes()))
        return pd.DataFrame(rows, columns=["f", "sub", "shared"])

    def spans(own: pd.DataFrame, merged: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(own) and len(merged):
            shared = np.sort(np.concatenate([np.frombuffer(b, np.uint64) for b in merged["shared"]]))
            which, start, digest = _digests(list(own["bytes"]))
            at = np.minimum(np.searchsorted(shared, digest), len(shared) - 1)
            hit = shared[at] == digest
            which, start = which[hit], start[hit]
            ends = np.searchsorted(which, np.arange(len(own) + 1))
            for k, r in enumerate(own.itertuples()):
                if r.n == 1:
                    out += [(r.mark, r.lo + a, r.lo + b) for a, b in _runs(start[ends[k] : ends[k + 1]])]
        return pd.DataFrame(out, columns=["mark", "a", "b"]).astype("int64")

    lists = hot.groupBy("f", "sub").applyInPandas(export, "f long, r long, sub long, digests binary")
    merged = lists.groupBy("f", "r").applyInPandas(merge, "f long, sub long, shared binary")
    return hot.groupBy("f", "sub").cogroup(merged.groupBy("f", "sub")).applyInPandas(spans, "mark long, a long, b long")


def _word_strings(found: DataFrame) -> DataFrame:
    """mark, s: digests of the strings of PASSAGE words in contexts of words."""

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "bytes"):
            data, at = buffers(batch.column("bytes"))
            _, _, word, begin = _word_hashes(data, at, Rolling(data))
            last = np.repeat(begin[1:] - PASSAGE, np.diff(begin))
            start = np.flatnonzero(np.arange(len(word)) <= last)
            row = np.searchsorted(begin, start, side="right") - 1
            yield pa.RecordBatch.from_arrays([batch.column("mark").take(pa.array(row)), pa.array(Rolling(word).of(start, start + PASSAGE).view(np.int64))], ["mark", "s"])

    return found.select("mark", "bytes").mapInArrow(strings, "mark long, s long")


def repeated_spans(docs: DataFrame) -> DataFrame:
    """mark, a, b: byte ranges to remove, not yet united; a and b null: mark shares a passage. docs: doc_id, mark, text."""
    anchors = staged(_anchored(docs), "anchors")
    each = anchors.groupBy("f", "ctx").agg(F.count("*").alias("n"), F.min(F.struct("mark", "lo", "size", "words")).alias("x"), F.max("mark").alias("other"))
    per = each.groupBy("f").agg(F.count("*").alias("d"), F.sum("n").alias("all"), F.min("n").alias("least"), (F.min("x.mark") < F.max("other")).alias("apart"), F.max("x.words").alias("of_words"))
    per = per.where("all > 1 AND (apart OR NOT of_words)").select("f", "d", "least")
    known = staged(each.join(per, "f").select("f", "ctx", "n", "d", "least", "x.*", "other"), "contexts")
    again = known.where("n > 1 AND NOT words").select("f", "ctx")
    whole = anchors.where("NOT words").join(again, ["f", "ctx"]).select("mark", F.col("lo").cast("long").alias("a"), (F.col("lo").cast("long") + F.col("size")).alias("b"))
    settled = staged(anchors.where("words").join(known.where("words AND mark < other").select("f", "ctx"), ["f", "ctx"]).select("mark").distinct(), "passages")
    unsettled = known.where("words AND mark = other").join(settled, "mark", "left_anti").select("f").distinct()
    parts = F.ceil(F.col("d") / HOT)
    # where every context of an anchor occurs again, all its strings do
    wanted = known.where("d > 1 AND least = 1 AND NOT words").unionByName(known.where("d > 1 AND words").join(unsettled, "f", "left_semi"))
    found = _cut_out(wanted, packed(docs.select("mark", "text"))).withColumn("parts", parts).withColumn("sub", F.pmod(F.xxhash64("ctx"), F.col("parts")))
    found = staged(found, "context-bytes")
    strings = staged(_word_strings(found.where("words")), "passage-strings")
    shared = strings.groupBy("s").agg(F.min("mark").alias("one"), F.max("mark").alias("other")).where("one < other").select("s")
    passages = settled.unionByName(strings.join(shared, "s").select("mark")).distinct().select("mark", F.lit(None).cast("long").alias("a"), F.lit(None).cast("long").alias("b"))
    found = found.where("NOT words")
    return whole.unionByName(_in_shards(found)).unionByName(_across_shards(found.where("parts > 1"))).unionByName(passages)


def without_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans, shares_passage of each row of docs (doc_id, text)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    read = docs.select("doc_id", F.xxhash64(F.lit("row"), "doc_id", text).alias("mark"), text.alias("text"))
    spans = repeated_spans(read).groupBy("mark").agg(F.array_sort(F.collect_set(F.when(F.col("a").isNotNull(), F.struct("a", "b")))).alias("spans"), F.bool_or(F.col("a").isNull()).alias("shares_passage"))

    def remove(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        z = zstandard.ZstdDecompressor()
        for pdf in batches:
            out = []
            for r in pdf.itertuples():
                raw, runs = z.decompress(r.blob), []
                for x in r.spans if r.spans is not None else []:
                    if runs and x["a"] <= runs[-1][1]:
                        runs[-1][1] = max(runs[-1][1], x["b"])
                    else:
                        runs.append([x["a"], x["b"]])
                kept, at = hashlib.sha256(), 0
                for a, b in runs:
                    kept.update(raw[at:a])
                    at = b
                kept.update(raw[at:])
                out.append((len(raw), sum(b - a for a, b in runs), len(runs), kept.hexdigest(), runs))
            yield pd.DataFrame(out, columns=["n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"]).assign(doc_id=pdf["doc_id"].to_numpy(), shares_passage=pdf["shares_passage"].to_numpy())

    kind = docs.schema["doc_id"].dataType.simpleString()
    joined = packed(read).join(spans, "mark", "left").select("doc_id", "blob", "spans", F.coalesce("shares_passage", F.lit(False)).alias("shares_passage"))
    return joined.mapInPandas(remove, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<array<long>>, shares_passage boolean")
