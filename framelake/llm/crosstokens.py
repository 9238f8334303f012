"""Alignment of two tokenizers over the same texts, by lockstep merging.

Both tokenizers' tokens cover the same bytes, a blank and the text. Walking both lists of token ends together, the one
that ends first steps on; where both end at one byte, a cut falls, and the tokens between two cuts are a group. One
state vector holds the pointers (A, B) of all documents of a slice, and a step moves all of them at once: it emits the
link of every pair of tokens it stands on and the cuts that it finds, and finished documents are compacted away. A
document of many tokens walks in several lanes, which begin at ends that binary search finds in both lists, so no
slice waits for its longest document. Groups with several tokens on both sides link every token of A with every one of B.

Token ids: A is a byte-level BPE file (.json) whose ids are in merge order, read by its ranks; B a sentencepiece
model. Where no piece of B holds a blank after another character, merges end at words, so words are encoded once each
and remembered; else whole texts are encoded.

Pairs of ids are counted by document over the whole corpus. Counts are looked up in two ways: the pairs that most
documents hold, at most HEAD of them, are sent to the tasks; all others meet their counts in a join. Of the rows that
grow with the corpus, none pass the driver: the highest count of each A id has a row for each id of the vocabulary.

Null and empty texts, and texts that either side's tokens don't spell exactly (U+2581 reads as a blank), have no tokens:
zeros and an empty digest. Rows are documents, so repeated rows count for themselves; null doc_ids are kept; an empty
table gives an empty result; other columns are ignored. Texts of any length are handled whole.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelake.llm.arrowtext import buffers, slices
from framelake.session import staged

HEAD = 1 << 19
#: A tokens of a lane; one more lane begins at the first common end after as many.
LANE, LOOK = 2048, 64
ID_BITS = 20
PAIR = (1 << 2 * ID_BITS) - 1
#: Groups with more links than these are counted by their distinct ids.
LINKS_AT_ONCE = 4096
CACHED_WORDS = 1 << 20
FLUSH_PAIRS = 4 << 20
_WORDS = re.compile(" +[^ ]*")


class Vocabulary:
    """The bytes of each id, as one buffer with offsets."""

    def __init__(self, entries: list[bytes]):
        if len(entries) > 1 << ID_BITS:
            raise ValueError("ids of a vocabulary must fit 20 bits")
        self.lengths = np.array([len(e) for e in entries], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)])[:-1]
        self.bytes = np.frombuffer(b"".join(entries), np.uint8)

    def spelled(self, ids: np.ndarray) -> np.ndarray:
        return self.bytes[ragged(self.starts[ids], self.lengths[ids])]


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices starts[i] .. starts[i] + lengths[i] - 1, one range after the other."""
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(int(lengths.sum()))


def byte_of_letter() -> dict[str, int]:
    """Byte-level vocabularies write printable bytes as their Latin-1 letter, the others as the letters from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}


def _flat(each: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    counts = np.fromiter(map(len, each), np.int64, len(each))
    return np.fromiter(chain.from_iterable(each), np.int32, int(counts.sum())), counts


class BytePairs:
    """A byte-level BPE file, special strings being plain text."""

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        letter = byte_of_letter()
        specials = {i for t, i in model["vocab"].items() if any(c not in letter for c in t) or t.startswith("<|")}
        ranks = {bytes(letter[c] for c in t): i for t, i in model["vocab"].items() if i not in specials}
        merged = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
        if merged != sorted(merged):
            raise ValueError("ids of the vocabulary are not in merge order")
        self.encoding = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        entries = [b""] * (max(model["vocab"].values()) + 1)
        for b, i in ranks.items():
            entries[i] = b
        self.vocabulary = Vocabulary(entries)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, counts) of a blank and each text."""
        return _flat([self.encoding.encode_ordinary(" " + t) for t in texts])


class Pieces:
    """A sentencepiece model with byte fallback."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        entries = [bytes([int(p[1:-1], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.vocabulary = Vocabulary(entries)
        self.blank = [pieces.index("▁")] if "▁" in pieces else []
        self.by_word = not any("▁" in p.lstrip("▁") for p in pieces) and self.model.encode("  a  b ") == [*self.model.encode("  a"), *self.model.encode(" b"), *self.blank]
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.starts, self.counts, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def _learn(self, words: set[str]) -> None:
        new = list(words)
        each = [e or self.blank for e in self.model.encode([w[1:] for w in new], num_threads=1)]  # the model adds the first blank, but none to empty texts
        ids, counts = _flat(each)
        self.index |= {w: len(self.counts) + i for i, w in enumerate(new)}
        self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(counts) - counts])
        self.counts = np.concatenate([self.counts, counts])
        self.ids = np.concatenate([self.ids, ids])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if not self.by_word:
            return _flat(self.model.encode(texts, num_threads=1))
        words = [_WORDS.findall(" " + t) for t in texts]
        if len(self.index) > CACHED_WORDS or len(self.ids) > 4 * CACHED_WORDS:
            self.clear()
        seen = set().union(*words).difference(self.index)
        if seen:
            self._learn(seen)
        known = np.fromiter(map(self.index.__getitem__, chain.from_iterable(words)), np.int64, sum(map(len, words)))
        counts = self.counts[known]
        at = np.concatenate([[0], np.cumsum(counts)])[np.cumsum([0, *map(len, words)])]
        ids = self.ids[ragged(self.starts[known], counts)]
        return ids, np.diff(at)


@lru_cache(maxsize=2)
def tokenizers(first: str, second: str) -> tuple[BytePairs, Pieces]:
    import public_tokenizers

    return BytePairs(public_tokenizers.path(first)), Pieces(public_tokenizers.path(second))


def _starts(counts: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(counts)])


def lanes(ends_a: np.ndarray, ends_b: np.ndarray, at_a: np.ndarray, at_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(A pointer, B pointer, A end) of each lane: ends run on over all documents, at_a and at_b hold where each begins."""
    a, b, stop = [at_a[:-1]], [at_b[:-1]], []
    for d in np.flatnonzero(np.diff(at_a) > 2 * LANE):
        for s in range(int(at_a[d]) + LANE, int(at_a[d + 1]) - LANE, LANE):
            some = ends_a[s : s + LOOK]
            place = np.searchsorted(ends_b, some)
            both = np.flatnonzero(ends_b[np.minimum(place, len(ends_b) - 1)] == some)
            if len(both):
                a.append(np.array([s + both[0] + 1]))
                b.append(np.array([place[both[0]] + 1]))
    a, b = np.concatenate(a), np.concatenate(b)
    order = np.argsort(a, kind="stable")
    a, b = a[order], b[order]
    stop = np.concatenate([a[1:], at_a[-1:]])
    return a, b, stop


def lockstep(ends_a: np.ndarray, ends_b: np.ndarray, at_a: np.ndarray, at_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(A token, B token) of each link between overlapping tokens, and which tokens of A and of B end at a cut.

    Ends are byte offsets over all documents, of which each has tokens, and ends alike on both sides.
    """
    a, b, stop = lanes(ends_a, ends_b, at_a, at_b)
    links_a, links_b = [], []
    cut_a, cut_b = np.zeros(len(ends_a), bool), np.zeros(len(ends_b), bool)
    while len(a):
        x, y = ends_a[a], ends_b[b]
        links_a.append(a)
        links_b.append(b)
        cut = x == y
        cut_a[a[cut]] = True
        cut_b[b[cut]] = True
        a, b = a + (x <= y), b + (x >= y)
        going = a < stop
        if not going.all():
            a, b, stop = a[going], b[going], stop[going]
    empty = np.zeros(0, np.int64)
    return np.concatenate(links_a or [empty]), np.concatenate(links_b or [empty]), cut_a, cut_b


@lru_cache(maxsize=2)
def _decimals(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each number below n its digits, first digit in the lowest byte, and how many there are."""
    text = [str(i).encode() for i in range(n)]
    return np.array([int.from_bytes(t, "little") for t in text], np.uint64), np.array([len(t) for t in text], np.uint64)


def digests(a: np.ndarray, b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray, last_group: np.ndarray) -> list[str]:
    """Of each document, whose last group is given, the hash of its groups as `a1,a2|b1;a3|b2,b3`."""
    m, n = np.bincount(group_a), np.bincount(group_b)
    place_a = np.arange(len(a)) + (np.cumsum(n) - n)[group_a]
    place_b = np.arange(len(b)) + np.cumsum(m)[group_b]
    ids, sign = np.empty(len(a) + len(b), np.int64), np.full(len(a) + len(b), ord(","), np.uint64)
    ids[place_a], ids[place_b] = a, b
    ends = np.cumsum(m + n)
    sign[ends - n - 1] = ord("|")
    sign[ends - 1] = ord(";")
    sign[ends[last_group] - 1] = 0
    digits, lengths = _decimals(1 << ID_BITS if ids.max(initial=0) >= 1 << 16 else 1 << 16)
    text = (digits[ids] | sign << (lengths[ids] * np.uint64(8))).view(np.uint8)
    size = np.cumsum(lengths[ids].astype(np.int64) + (sign > 0))
    raw = text[text > 0].tobytes()
    stop = size[ends[last_group] - 1].tolist()
    return [hashlib.sha256(raw[lo:hi]).hexdigest() for lo, hi in zip([0, *stop[:-1]], stop, strict=True)]


def _crossed(a: np.ndarray, b: np.ndarray, m: np.ndarray, n: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document and pair, links) of whole groups, all tokens of A with all of B; groups lie one after the other."""
    at_a, at_b = np.cumsum(m) - m, np.cumsum(n) - n
    small = np.flatnonzero(m * n <= LINKS_AT_ONCE)
    each = (m * n)[small]
    within = ragged(np.zeros(len(small), np.int64), each)
    wide = np.repeat(n[small], each)
    x = a[np.repeat(at_a[small], each) + within // np.maximum(wide, 1)]
    y = b[np.repeat(at_b[small], each) + within % np.maximum(wide, 1)]
    keys, links = [_key(np.repeat(doc[small], each), x, y)], [np.ones(len(x), np.int64)]
    for g in np.flatnonzero(m * n > LINKS_AT_ONCE):
        x, i = np.unique(a[at_a[g] : at_a[g] + m[g]], return_counts=True)
        y, j = np.unique(b[at_b[g] : at_b[g] + n[g]], return_counts=True)
        keys.append(_key(doc[g], np.repeat(x, len(y)), np.tile(y, len(x))))
        links.append(np.outer(i, j).ravel())
    return np.concatenate(keys), np.concatenate(links)


def _key(doc: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (np.asarray(doc, np.int64) << 2 * ID_BITS) | (a.astype(np.int64) << ID_BITS) | b


def aligned(texts: list[str | None], first: BytePairs, second: Pieces) -> dict:
    """Of each text n_a, n_b, n_groups, n_links and groups_sha256; keys and links: its pairs of ids, in order."""
    out = {k: np.zeros(len(texts), np.int64) for k in ("n_a", "n_b", "n_groups", "n_links")} | {"groups_sha256": [""] * len(texts)}
    some = np.array([i for i, t in enumerate(texts) if t], np.int64)
    given = [texts[i] for i in some]
    (a, n_a), (b, n_b) = first.encode(given), second.encode(given)
    wanted, at = buffers(pa.array([" " + t for t in given], pa.large_string()))
    right = np.ones(len(given), bool)
    for side, ids, counts in ((first, a, n_a), (second, b, n_b)):
        spelled, size = side.vocabulary.spelled(ids), _starts(side.vocabulary.lengths[ids])[_starts(counts)]
        if not np.array_equal(spelled, wanted):
            right &= [bool(np.array_equal(spelled[lo:hi], wanted[p:q])) for lo, hi, p, q in zip(size[:-1], size[1:], at[:-1], at[1:], strict=True)]
    if not right.all():
        a, b, some, n_a, n_b = a[np.repeat(right, n_a)], b[np.repeat(right, n_b)], some[right], n_a[right], n_b[right]
    if not len(some):
        return out | {"keys": np.zeros(0, np.int64), "links": np.zeros(0, np.int64)}
    ends_a, ends_b = np.cumsum(first.vocabulary.lengths[a]), np.cumsum(second.vocabulary.lengths[b])
    at_a, at_b = _starts(n_a), _starts(n_b)
    link_a, link_b, cut_a, cut_b = lockstep(ends_a, ends_b, at_a, at_b)
    group_a, group_b = np.cumsum(cut_a) - cut_a, np.cumsum(cut_b) - cut_b
    m, n = np.bincount(group_a), np.bincount(group_b)
    last = group_a[at_a[1:] - 1]
    doc = np.repeat(some, np.diff(last, prepend=-1))
    out["n_a"][some], out["n_b"][some], out["n_groups"][some] = n_a, n_b, np.diff(last, prepend=-1)
    np.add.at(out["n_links"], doc, m * n)
    for i, h in zip(some.tolist(), digests(a, b, group_a, group_b, last), strict=True):
        out["groups_sha256"][i] = h
    crossed = (m > 1) & (n > 1)
    plain = ~crossed[group_a[link_a]]
    keys = _key(doc[group_a[link_a[plain]]], a[link_a[plain]], b[link_b[plain]])
    more, times = _crossed(a[crossed[group_a]], b[crossed[group_b]], m[crossed], n[crossed], doc[crossed])
    keys, links = np.concatenate([keys, more]), np.concatenate([np.ones(len(keys), np.int64), times])
    order = np.argsort(keys)
    keys, links = keys[order], links[order]
    new = np.flatnonzero(np.diff(keys, prepend=-1))
    return out | {"keys": keys[new], "links": np.add.reduceat(links, new) if len(new) else links}


def _planes(x: np.ndarray) -> bytes:
    """Longs by their bytes, the lowest of all first, compressed."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8).T).tobytes())


def _numbers(data: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(8, -1).T).view(np.int64).ravel() if len(raw) else np.zeros(0, np.int64)


def _slices_of(docs: DataFrame, first: str, second: str) -> DataFrame:
    """A row for each slice of documents: what aligned() gives, row being a number of the document's own."""
    read = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    kind = read.schema["doc_id"].dataType.simpleString()

    def walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 40
        both = tokenizers(first, second)
        for batch in slices(batches):
            n = batch.num_rows
            x = aligned(batch.column("text").to_pylist(), *both)
            lists = [pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), c) for c in (batch.column("doc_id"), *(pa.array(x[k]) for k in ("n_a", "n_b", "n_groups", "n_links")), pa.array(x["groups_sha256"], pa.string()))]
            yield pa.RecordBatch.from_arrays([pa.array([row]), *lists, pa.array([_planes(np.diff(x["keys"], prepend=0))]), pa.array([_planes(x["links"])])], ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "keys", "links"])
            row += n

    return read.mapInArrow(walked, f"row long, doc_id array<{kind}>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, groups_sha256 array<string>, keys binary, links binary")


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(pair, docs), added up as far as memory goes."""
    pairs, docs, held = [], [], 0

    def flushed() -> pa.RecordBatch:
        p, d = np.concatenate(pairs), np.concatenate(docs)
        order = np.argsort(p)
        p, d = p[order], d[order]
        new = np.flatnonzero(np.diff(p, prepend=-1))
        return pa.RecordBatch.from_arrays([pa.array(p[new]), pa.array(np.add.reduceat(d, new))], ["pair", "docs"])

    for batch in batches:
        for data in batch.column("keys").to_pylist():
            p, d = np.unique(np.cumsum(_numbers(data)) & PAIR, return_counts=True)
            if len(p):
                pairs.append(p)
                docs.append(d)
                held += len(p)
            if held > FLUSH_PAIRS:
                yield flushed()
                pairs, docs, held = [], [], 0
    if pairs:
        yield flushed()


def pair_counts(walked: DataFrame) -> DataFrame:
    """pair, docs, best: how many documents hold each linked pair, and whether its A id has no greater count."""
    counts = staged(walked.select("keys").mapInArrow(_counted, "pair long, docs long").groupBy("pair").agg(F.sum("docs").alias("docs")), "pair-counts")
    a = F.shiftright("pair", ID_BITS)
    top = counts.groupBy(a.alias("a")).agg(F.max("docs").alias("most"))  # a row for each id of the vocabulary
    return staged(counts.join(F.broadcast(top), a == top["a"]).select("pair", "docs", (F.col("docs") == F.col("most")).alias("best")), "pair-table")


def head_of(pairs: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pair, docs, best), in order of pairs: those held by at least 2**k documents, k being the least that leaves no more than most."""
    sizes = {r.k: r["count"] for r in pairs.groupBy(F.floor(F.log2("docs")).alias("k")).count().collect()}  # 63 rows at most
    k, n = 63, 0
    while k > 0 and n + sizes.get(k - 1, 0) <= most:
        k, n = k - 1, n + sizes.get(k - 1, 0)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    got = pairs.where(F.col("docs") >= 1 << k).toArrow()
    order = np.argsort(got.column("pair").to_numpy())
    return tuple(got.column(c).to_numpy()[order] for c in ("pair", "docs", "best"))


def alignments(docs: DataFrame, first: str = "byte_bpe_50k.json", second: str = "piece_bpe_32k.model", head: int = HEAD) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of each row of docs."""
    spark = docs.sparkSession
    walked = staged(_slices_of(docs, first, second), "token-slices")
    pairs = pair_counts(walked)
    known = spark.sparkContext.broadcast(head_of(pairs, head))
    kind = docs.select("doc_id").schema["doc_id"].dataType.simpleString()

    def found(keys: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(document, pair, whether it is among the head, docs, best)"""
        all_pairs, docs_of, best = known.value
        keys = np.cumsum(_numbers(keys))
        pair = keys & PAIR
        if not len(all_pairs):
            return keys >> 2 * ID_BITS, pair, np.zeros(len(keys), bool), np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        at = np.minimum(np.searchsorted(all_pairs, pair), len(all_pairs) - 1)
        here = all_pairs[at] == pair
        return keys >> 2 * ID_BITS, pair, here, np.where(here, docs_of[at], 0), here & best[at]

    def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                doc, pair, here, _, _ = found(r["keys"])
                if not here.all():
                    yield pa.RecordBatch.from_arrays([pa.array(r["row"] + doc[~here]), pa.array(pair[~here]), pa.array(_numbers(r["links"])[~here])], ["row", "pair", "links"])

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.slice(i, 1)
                doc_id = one.column("doc_id").flatten()
                doc, _, _, count, best = found(one.column("keys")[0].as_py())
                links, n = _numbers(one.column("links")[0].as_py()), len(doc_id)
                sums, bests = np.zeros(n, np.int64), np.zeros(n, np.int64)
                np.add.at(sums, doc, links * count)
                np.add.at(bests, doc, links * best)
                rest_of = [one.column(c).flatten() for c in ("n_a", "n_b", "n_groups", "n_links", "groups_sha256")]
                yield pa.RecordBatch.from_arrays([pa.array(one.column("row")[0].as_py() + np.arange(n)), doc_id, *rest_of, pa.array(bests), pa.array(sums)], ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum"])

    rare = walked.select("row", "keys", "links").mapInArrow(rest, "row long, pair long, links long").join(pairs, "pair")
    rare = rare.groupBy("row").agg(F.sum(F.col("links") * F.col("docs")).alias("rare_sum"), F.sum(F.when(F.col("best"), F.col("links")).otherwise(0)).alias("rare_best"))
    head_sums = walked.mapInArrow(summed, f"row long, doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long")
    both = head_sums.join(rare, "row", "left")
    return both.select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", (F.col("n_best") + F.coalesce("rare_best", F.lit(0))).alias("n_best"),
        (F.col("count_sum") + F.coalesce("rare_sum", F.lit(0))).alias("count_sum"), "groups_sha256",
    )
