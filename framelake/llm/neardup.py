"""Near duplicates: consistent weighted sampling over TF-IDF shingles, banded and verified.

A text's shingles are its runs of FIVE words in lower case; a text of fewer words is one shingle. A shingle that
occurs tf times in a text and in df of the N texts weighs (1 + ln tf) (1 + min(ln(N / df), ln RARE) / ln RARE):
what fewer than one text in RARE holds counts as rare, so the weights of a large group of copies stay comparable.
df is counted over all texts in a count-min table of fixed size, whose mean load stays far under N / RARE.

Samples: a shingle of weight w counts as PER_WEIGHT * w elements, a fraction of one by a chance of its hash, so that
equal shares of elements are equal shares of weight. Each element is hashed to one of SLOTS slots, where the least
hash wins; slots left empty are filled by further rounds of hashing. So the share of slots that agree estimates the
weighted Jaccard similarity without bias. BANDS bands of ROWS samples are the buckets. Texts with equal shingles and
counts are one node, and buckets with the same nodes are one bucket.

Links are found inside buckets, where a task holds the whole shingle sets of a block of nodes and computes the
weighted Jaccard similarity of every two that its links so far leave apart. It returns only the links that unite two
classes, at most one less than the block has nodes, whatever the number of similar pairs. A bucket of over BLOCK
nodes or BLOCK_BYTES of text is dealt into blocks that share one node. If the classes found still tear such a bucket
apart, then its blocks meet each other: those of its largest class with the rest, those of the rest with each other.
So every two nodes of a bucket are in one class or have been compared. The links only have to join classes, so their
number isn't that of all similar pairs.

Null texts and texts without words: equal texts without words are one class; a null text is a class of its own with
the others of its doc_id. Every row gets the class of its own text, also where several rows share a doc_id. A class
is named by its least doc_id; where that names another class already, or is null or no whole number, by a hash under
-2**62. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framelake.llm.arrowtext import Rolling, buffers, folded, mixed, packed, slices, words
from framelake.llm.rows import unused
from framelake.operators.graph import components
from framelake.session import staged

FIVE, SIMILARITY, RARE = 5, 0.8, 100
BANDS, ROWS = 20, 4
SLOTS = BANDS * ROWS
TABLE_BITS, PARTS = 20, 16
#: Nodes, and bytes of their texts, that a task compares at once.
BLOCK, BLOCK_BYTES = 1024, 8 << 20
#: Elements that stand for a shingle of weight 1.
PER_WEIGHT = 4
_FREE = np.uint64((1 << 64) - 1)
ROUNDS = 12
#: Text bytes counted and sampled at once: short texts need many samples for each byte.
COUNTED_BYTES, SKETCHED_BYTES = 2 << 20, 1 << 19
_U = np.uint64


def shingles(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, hash, count) of the distinct shingles of each row, sorted by row and hash."""
    data = folded(data)
    lo, hi, row = words(data, at)
    if not len(lo):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    word = Rolling(data).of(lo, hi)
    n = len(word)
    per = np.bincount(row, minlength=len(at) - 1)
    first = np.cumsum(per) - per
    length = np.minimum(FIVE, per)[row]
    begins = np.arange(n) + length <= (first + per)[row]
    start = np.flatnonzero(begins)
    out = np.zeros(len(start), np.uint64)
    for k in range(FIVE):
        some = length[start] > k
        i = start[some]
        out[some] = out[some] * _U(0x9E3779B97F4A7C15) + word[i + k]
    out, row = mixed(out), row[start]
    # one sort: rows are in order already, so the row goes into the top bits of a second key
    order = np.lexsort((out, row))
    out, row = out[order], row[order]
    new = np.ones(len(out), bool)
    new[1:] = (out[1:] != out[:-1]) | (row[1:] != row[:-1])
    place = np.flatnonzero(new)
    return row[place], out[place], np.diff(np.append(place, len(out)))


def _cells(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    mask = _U((1 << TABLE_BITS) - 1)
    return (h & mask).astype(np.int64), ((h >> _U(40)) & mask).astype(np.int64) + (1 << TABLE_BITS)


def document_counts(docs: DataFrame) -> tuple[np.ndarray, int]:
    """The count-min table of df (two rows, one after the other) and N."""
    size = (2 << TABLE_BITS) // PARTS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, n = np.zeros(2 << TABLE_BITS, np.int64), 0
        for batch in slices(batches, limit=COUNTED_BYTES):
            _, h, _ = shingles(*buffers(batch.column("text")))
            n += batch.num_rows
            for cells in _cells(h):
                table += np.bincount(cells, minlength=len(table))
        if n:
            blobs = [zlib.compress(table[k * size : (k + 1) * size].astype(np.int64).tobytes(), 1) for k in range(PARTS)]
            yield pa.RecordBatch.from_arrays([pa.array(range(PARTS), pa.int32()), pa.array(blobs, pa.binary()), pa.array([n if k == 0 else 0 for k in range(PARTS)], pa.int64())], ["part", "counts", "n"])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(size, np.int64)
        for b in pdf["counts"]:
            total += np.frombuffer(zlib.decompress(b), np.int64)
        return pd.DataFrame([[int(pdf["part"].iloc[0]), zlib.compress(total.tobytes(), 1), int(pdf["n"].sum())]], columns=["part", "counts", "n"])

    schema = "part int, counts binary, n long"
    # tables of fixed size, summed in two steps so that no task gets those of all tasks
    sums = docs.select("text").mapInArrow(count, schema)
    some = sums.withColumn("k", F.pmod(F.xxhash64("counts"), F.lit(8))).groupBy("part", "k").applyInPandas(lambda pdf: add(pdf), schema)
    rows = some.groupBy("part").applyInPandas(add, schema).collect()
    table = np.zeros(2 << TABLE_BITS, np.int64)
    for r in rows:
        table[r.part * size : (r.part + 1) * size] = np.frombuffer(zlib.decompress(r.counts), np.int64)
    return table, sum(r.n for r in rows)


def levels(table: np.ndarray, n: int) -> np.ndarray:
    """The IDF factor of each cell as 0 .. 255 (1 .. 2)."""
    rare = np.log(max(n, 1) / np.maximum(table, 1)).clip(0, np.log(RARE)) / np.log(RARE)
    return np.rint(rare * 255).astype(np.uint8)


def weights(h: np.ndarray, count: np.ndarray, idf: np.ndarray) -> np.ndarray:
    a, b = _cells(h)
    return (1 + np.log(count)) * (1 + np.maximum(idf[a], idf[b]) / 255.0)


def _elements(row: np.ndarray, h: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the elements that stand for each shingle: PER_WEIGHT times its weight, the last by a chance of its hash.

    The elements of a smaller weight are among those of a larger one, so the share of common elements of two sets is
    their weighted Jaccard similarity, but for the chance.
    """
    mass = w * PER_WEIGHT
    whole = np.floor(mass).astype(np.int64)
    last = mixed(h + _U(0x51ED27) + mixed(whole.astype(np.uint64)))
    n = whole + ((last >> _U(11)).astype(np.float64) * 2.0**-53 < mass - whole)
    which = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return np.repeat(row, n), mixed(np.repeat(h, n) + which.astype(np.uint64) * _U(0x9E3779B97F4A7C15))


def sketches(row: np.ndarray, h: np.ndarray, w: np.ndarray, rows: int) -> np.ndarray:
    """rows x SLOTS tokens; rows without shingles are 0. row is in order."""
    best = np.full(rows * SLOTS, _FREE)
    has = np.zeros(rows, bool)
    has[row] = True
    row, h = _elements(row, h, w)
    for seed in range(ROUNDS):
        if not len(row):
            break
        value = mixed(h + _U(seed * 2 + 1))
        slot = row * SLOTS + ((value >> _U(33)).astype(np.int64) % SLOTS)
        value = mixed(value) >> _U(1)
        free = best[slot] == _FREE
        np.minimum.at(best, slot[free], value[free])
        some = (best.reshape(-1, SLOTS) == _FREE).any(axis=1)[row]
        row, h = row[some], h[some]
    empty = np.flatnonzero((best == _FREE) & np.repeat(has, SLOTS))
    if len(empty):  # each takes the least of all of the row's elements under a seed of its own
        per = np.bincount(row, minlength=rows)
        first = np.cumsum(per) - per
        n = per[empty // SLOTS]
        which = np.repeat(first[empty // SLOTS], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        slot = np.repeat(empty, n)
        value = mixed(h[which] + mixed((slot % SLOTS).astype(np.uint64) + _U(77))) >> _U(1)
        np.minimum.at(best, slot, value)
    return np.where(best == _FREE, _U(0), best | _U(1)).reshape(rows, SLOTS)


def _sampled(rows: DataFrame, idf: np.ndarray) -> DataFrame:
    """doc_id, doc, mark, key (16 bytes: equal for equal shingle counts), bands, bytes of each row (doc_id, doc, mark, text)."""
    shared = rows.sparkSession.sparkContext.broadcast(idf)

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=SKETCHED_BYTES):
            data, at = buffers(batch.column("text"))
            n = batch.num_rows
            row, h, count = shingles(data, at)
            slots = sketches(row, h, weights(h, count, shared.value), n)
            bands = np.zeros((n, BANDS), np.uint64)
            for k in range(ROWS):
                bands = bands * _U(0x9E3779B97F4A7C15) + slots[:, k::ROWS]
            bands = mixed(bands + np.arange(BANDS, dtype=np.uint64) * _U(0xD1B54A32D192ED03))
            c = count.astype(np.uint64)
            key = np.zeros((n, 2), np.uint64)
            ends = np.searchsorted(row, np.arange(n + 1))
            for j, s in enumerate((_U(3), _U(11))):
                sums = np.concatenate([[_U(0)], np.cumsum(mixed(h * s + c * _U(0x2545F4914F6CDD1D)))])
                key[:, j] = mixed(sums[ends[1:]] - sums[ends[:-1]] + s)
            has = ends[1:] > ends[:-1]
            if not has.all():
                roll = Rolling(data)
                for i in np.flatnonzero(~has):
                    key[i] = [roll.of(at[i : i + 1], at[i + 1 : i + 2])[0], _U(at[i + 1] - at[i])]
                    if not batch.column("text")[int(i)].is_valid:
                        key[i] = [_U(batch.column("mark")[int(i)].as_py() % (1 << 64)), _U((1 << 64) - 1)]
            flat = pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), n, [None, pa.py_buffer(np.ascontiguousarray(key))]).cast(pa.binary())
            offsets = np.concatenate([[0], np.cumsum(has * BANDS)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(bands[has].ravel().view(np.int64)))
            kept = [batch.column(c) for c in ("doc_id", "doc", "mark")]
            yield pa.RecordBatch.from_arrays([*kept, flat, lists, pa.array(np.diff(at))], ["doc_id", "doc", "mark", "key", "bands", "bytes"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(sample, f"doc_id {kind}, doc long, mark long, key binary, bands array<bigint>, bytes long")


def links_of_block(h: np.ndarray, w: np.ndarray, ends: np.ndarray, label: np.ndarray, side: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Pairs of nodes that unite all classes of a block that similar pairs connect.

    h, w: hashes and weights of the nodes' shingles, node by node up to ends; label: the nodes' classes so far; side:
    where both 0 and 1 occur, only pairs across are compared.
    """
    size = np.diff(ends, prepend=0)
    total = np.add.reduceat(w, ends - size)
    order = np.argsort(total, kind="stable")
    total, label, side = total[order], label[order].copy(), side[order]
    size = size[order]
    at = np.concatenate([[0], np.cumsum(size)])
    entry = np.arange(at[-1]) + np.repeat((ends - np.diff(ends, prepend=0))[order] - at[:-1], size)
    _, name, count = np.unique(h[entry], return_inverse=True, return_counts=True)
    common = count[name] > 1  # what one node alone holds is in no intersection
    w, name = w[entry][common], name[common]
    at = np.concatenate([[0], np.cumsum(common)])[at]
    across, held, out = bool(side.any()) and not side.all(), np.zeros(len(count)), []
    # a similarity is at most the ratio of the total weights, so candidates follow each other
    last = np.searchsorted(total, total * (1 + 1e-9) / similarity, side="right")
    for i in range(len(total) - 1):
        apart = label[i + 1 : last[i]] != label[i]
        if across:
            apart &= side[i + 1 : last[i]] != side[i]
        apart = np.flatnonzero(apart) + i + 1
        if not len(apart) or at[i] == at[i + 1]:
            continue
        lo, hi = at[apart[0]], at[apart[-1] + 1]
        mine = name[at[i] : at[i + 1]]
        held[mine] = w[at[i] : at[i + 1]]
        sums = np.concatenate([[0.0], np.cumsum(np.minimum(held[name[lo:hi]], w[lo:hi]))])
        shared = sums[at[apart + 1] - lo] - sums[at[apart] - lo]
        held[mine] = 0
        near = apart[shared >= (similarity - 1e-9) * (total[i] + total[apart] - shared)]
        if len(near):
            labels, one = np.unique(label[near], return_index=True)
            out += [(int(order[i]), int(order[j])) for j in near[one]]
            label[np.isin(label, labels)] = label[i]
    return out


def _links(blocks: DataFrame, idf: np.ndarray, similarity: float) -> DataFrame:
    """a < b: what links_of_block finds in each block (key, sub) of blocks (key, sub, node, label, side, blob)."""
    shared = blocks.sparkSession.sparkContext.broadcast(idf)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z, held, last = zstandard.ZstdDecompressor(), [], None

        def flush() -> list[tuple[int, int]]:
            node, label, side, size, h, w = (np.concatenate(x) for x in zip(*held, strict=True))
            pairs = links_of_block(h, w, np.cumsum(size), label, side, similarity) if len(node) > 1 else []
            return [(min(p), max(p)) for p in ((int(node[i]), int(node[j])) for i, j in pairs)]

        for batch in slices(batches, "blob", 1 << 18):
            text = [z.decompress(x.as_py()) for x in batch.column("blob")]
            row, h, count = shingles(np.frombuffer(b"".join(text), np.uint8), np.cumsum([0, *map(len, text)]))
            w = weights(h, count, shared.value)
            at = np.searchsorted(row, np.arange(len(text) + 1))
            key, sub, node, label, side = (batch.column(c).to_numpy() for c in ("key", "sub", "node", "label", "side"))
            cut = np.flatnonzero((key[1:] != key[:-1]) | (sub[1:] != sub[:-1])) + 1
            found: list[tuple[int, int]] = []
            for lo, hi in zip([0, *cut], [*cut, len(text)], strict=True):
                if held and last != (key[lo], sub[lo]):
                    found += flush()
                    held = []
                last = (key[lo], sub[lo])
                held.append((node[lo:hi], label[lo:hi], side[lo:hi], np.diff(at[lo : hi + 1]), h[at[lo] : at[hi]], w[at[lo] : at[hi]]))
            if found:
                yield _pairs(found)
        if held and (found := flush()):
            yield _pairs(found)

    dealt = blocks.repartition("key", "sub").sortWithinPartitions("key", "sub", "node")
    return dealt.mapInArrow(run, "a long, b long")


def _pairs(found: list[tuple[int, int]]) -> pa.RecordBatch:
    both = np.array(found, np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["a", "b"])


def _buckets(nodes: DataFrame) -> DataFrame:
    """key, sub, node, parts: members of the buckets of several nodes, one bucket for each set of nodes, and their blocks."""
    each = nodes.select("node", "bytes", F.explode("bands").alias("key"))
    same = (F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y"))
    several = each.groupBy("key").agg(F.count("*").alias("n"), F.sum("bytes").alias("size"), F.min("node").alias("hub"), *same).where("n > 1")
    several = several.groupBy("n", "hub", "x", "y").agg(F.min("key").alias("key"), F.max("size").alias("size"))
    parts = F.ceil(F.greatest(F.col("n") / BLOCK, F.col("size") / BLOCK_BYTES))
    several = several.select("key", "hub", F.least(parts, F.col("n")).alias("parts"))
    dealt = each.join(several, "key").where("parts = 1 OR node <> hub").select("key", F.expr("pmod(xxhash64(node), parts)").alias("sub"), "node", "parts")
    hubs = several.where("parts > 1").select("key", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("sub"), F.col("hub").alias("node"), "parts")
    return dealt.unionByName(hubs)


def _torn(members: DataFrame, labels: DataFrame) -> DataFrame:
    """key, sub, node, label, side: pairs of blocks of the dealt buckets that lie in several classes.

    The nodes of a bucket's largest class and the rest are dealt into blocks of their own; each block of the rest meets
    itself and all others. side tells the two blocks that meet apart.
    """
    seen = members.where("parts > 1").dropDuplicates(["key", "node"]).join(labels, "node")
    per = seen.groupBy("key", "label", "parts").agg(F.count("*").alias("n"))
    torn = per.groupBy("key", "parts").agg(F.max(F.struct("n", "label")).alias("most"), F.sum("n").alias("n")).where("n > most.n")
    share = lambda n: F.ceil(F.col("parts") * n / F.col("n"))
    torn = torn.select("key", F.col("most.label").alias("main"), share(F.col("most.n")).alias("mains"), share(F.col("n") - F.col("most.n")).alias("rests"))
    dealt = seen.join(torn, "key").withColumn("own", F.expr("if(label = main, rests + pmod(xxhash64(node), mains), pmod(xxhash64(node), rests))"))
    meets = dealt.withColumn("with", F.explode(F.expr("sequence(0L, if(label = main, rests, rests + mains) - 1)")))
    return meets.select("key", F.expr("least(own, with) * (rests + mains) + greatest(own, with)").alias("sub"), "node", "label", F.expr("int(own > with)").alias("side"))


def _classes(docs: DataFrame, similarity: float) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, mark, key) and nodes (key, node, label, mark of the row that stands for the node)."""
    rows = docs.select("doc_id", _number(docs).alias("doc"), _mark(docs).alias("mark"), F.col("text").cast("string").alias("text"))
    idf = levels(*document_counts(rows))
    sampled = staged(_sampled(rows, idf), "samples")
    first = F.min(F.struct(F.col("doc").isNull().alias("no"), "doc", "mark", "bands", "bytes")).alias("x")
    groups = sampled.groupBy("key").agg(first).select("key", "x.doc", "x.mark", "x.bands", "x.bytes")
    hashed = F.xxhash64("key")
    nth = F.row_number().over(Window.partitionBy("doc", F.when(F.col("doc").isNull(), hashed)).orderBy("key"))
    node = F.when(F.col("doc").isNotNull() & (nth == 1), F.col("doc")).otherwise(-(1 << 62) - 1 - F.pmod(hashed, F.lit(1 << 62)))
    nodes = staged(groups.select("key", node.alias("node"), "mark", "bands", "bytes"), "nodes")
    members = staged(_buckets(nodes), "members")
    wanted = members.select("node").distinct().join(nodes.select("node", "mark"), "node")
    blobs = packed(rows.select("mark", "text")).join(wanted, "mark").dropDuplicates(["node"])
    blobs = staged(blobs.select("node", "blob"), "blobs")
    own = members.join(blobs, "node").withColumns({"label": F.col("node"), "side": F.lit(0)})
    links = staged(_links(own, idf, similarity), "links")
    labels = components(nodes.select("node"), links)
    if not members.where("parts > 1").isEmpty():
        more = staged(_links(_torn(members, labels).join(blobs, "node"), idf, similarity), "more-links")
        if not more.isEmpty():
            labels = components(nodes.select("node"), links.unionByName(more))
    return sampled.select("doc_id", "mark", "key"), nodes.select("key", "node", "mark").join(labels, "node")


def _number(docs: DataFrame) -> Column:
    """doc_id where it is a whole number."""
    return F.col("doc_id").cast("long") if isinstance(docs.schema["doc_id"].dataType, T.IntegralType) else F.lit(None).cast("long")


def _mark(docs: DataFrame) -> Column:
    """Tells rows of different ids or texts apart."""
    return F.xxhash64(F.col("doc_id").isNull(), F.col("text").isNull(), F.col("doc_id"), F.col("text"))


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, class_id (least id of the class), text_id (least id of equal texts) of each row."""
    rows, nodes = _classes(docs, similarity)
    named = nodes.select("key", F.col("label").alias("class_id"), F.col("node").alias("text_id"))
    return rows.select("doc_id", "key").join(named, "key").select("doc_id", "class_id", "text_id")


def one_of_each(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """docs with one row of each class: that of its least id."""
    _, nodes = _classes(docs, similarity)
    mark = unused(docs, "mark")
    kept = nodes.where("node = label").select(F.col("mark").alias(mark))
    return docs.withColumn(mark, _mark(docs)).join(kept, mark, "left_semi").dropDuplicates([mark]).drop(mark)
