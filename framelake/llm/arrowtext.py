"""Text columns as byte buffers: what the numpy operators share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame

#: Text bytes worked on at once; one longer text makes a slice of its own.
SLICE_BYTES = 4 << 20
_ODD = np.uint64(0x9E3779B97F4A7C15)


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all rows and the row offsets (nulls: empty), starting at 0."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    at = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    if not len(at):
        at = np.zeros(1, np.int64)
    return data[at[0] : at[-1]], at - at[0]


def slices(batches: Iterator[pa.RecordBatch], text: str | int = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of batches in slices of about limit text bytes."""
    for batch in batches:
        _, at = buffers(batch.column(text))
        lo = 0
        while lo < batch.num_rows:
            hi = max(lo + 1, int(np.searchsorted(at, at[lo] + limit, side="right")) - 1)
            yield batch.slice(lo, hi - lo)
            lo = hi


def packed(docs: DataFrame) -> DataFrame:
    """docs with blob, the compressed text, in place of text: for texts that are about to be dealt by another column."""
    others = [f for f in docs.schema.fields if f.name != "text"]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdCompressor(level=1)
        for batch in slices(batches):
            data, at = buffers(batch.column("text"))
            raw = data.tobytes()
            blobs = [z.compress(raw[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in others), pa.array(blobs, pa.binary())], [*(f.name for f in others), "blob"])

    return docs.mapInArrow(pack, ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in others] + ["blob binary"]))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of uint64 that spreads every bit."""
    x = np.asarray(x, np.uint64)
    if not x.ndim:
        return mixed(x[None])[0]
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Rolling:
    """Hashes of any range of a buffer of bytes, or of hashes, from prefix sums modulo 2**64."""

    def __init__(self, data: np.ndarray, seed: int = 1):
        rng = np.random.default_rng(seed)
        base = int(rng.integers(1 << 61, 1 << 63)) | 1
        self.table = rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        n = len(data)
        self.inverse = _powers(pow(base, -1, 1 << 64), n + 1)
        sums = data.copy() if data.dtype == np.uint64 else self.table[data]
        sums *= _powers(base, n)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(sums, out=self.sums[1:])

    def of(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        return mixed((self.sums[hi] - self.sums[lo]) * self.inverse[lo])

    def each(self, width: int) -> np.ndarray:
        """Of every range of this width, by start."""
        n = len(self.sums) - width
        if n <= 0:
            return np.zeros(0, np.uint64)
        return mixed((self.sums[width:] - self.sums[:n]) * self.inverse[:n])


_CACHED: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; the last tables are kept."""
    have = _CACHED.get(base)
    if have is None or len(have) < n:
        size = max(n, 1024)
        out = np.empty(size, np.uint64)
        out[0] = 1
        done, step = 1, base
        while done < size:
            k = min(done, size - done)
            np.multiply(out[:k], np.uint64(step), out=out[done : done + k])
            done += k
            step = step * step % (1 << 64)
        _CACHED[base] = have = out
    return have[:n]


def _fold_table() -> np.ndarray:
    """ASCII letters in lower case, digits and bytes of longer characters as they are, all else a blank."""
    out = np.full(256, 0x20, np.uint8)
    for c in range(256):
        if chr(c).isalnum() and c < 128:
            out[c] = ord(chr(c).lower())
        elif c >= 128:
            out[c] = c
    return out


_FOLD = _fold_table()


def folded(data: np.ndarray) -> np.ndarray:
    """The bytes in lower case (ASCII and Latin-1 letters), other ASCII characters as blanks; none is added or lost."""
    out = _FOLD[data]
    if len(data) > 1:
        upper = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        out[1:][upper] |= 0x20
    return out


def words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of the words of folded rows."""
    if not len(data):
        return (np.zeros(0, np.int64),) * 3
    inside = data != 0x20
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    begin, end = at[:-1], at[1:]
    some = end > begin
    first[begin[some]] = inside[begin[some]]
    last[end[some] - 1] = inside[end[some] - 1]
    lo = np.flatnonzero(first)
    return lo, np.flatnonzero(last) + 1, np.searchsorted(at, lo, side="right") - 1
