"""WARC archives whose records are compressed one by one with a shared Zstandard dictionary.

Each archive starts with a skippable frame that holds the dictionary, so it can be read alone; then comes one
frame for each record. The dictionary is trained on a bounded sample of distinct payloads (DICTIONARY_SAMPLES of
them, each cut to DICTIONARY_SAMPLE_BYTES, smallest digests first), so its cost does not grow with the input. Where
they are too few or too short to train on, the samples themselves are the dictionary.

Of records with equal payloads (from min_revisit_bytes on) the one with the smallest page_id is a response and
the others are revisits, which refer to it by its record id and hold no payload. Archives are rows of a Parquet
table (archive, content): a store that only Spark writes to holds them like any other. They are closed at
ARCHIVE_BYTES. Equal payloads are compared by digest, on keys alone; payloads are dealt by page_id and digest, so equal
pages do not gather in one task.

Null payloads are empty; null urls are written as an empty target; a null page_id sorts before all others and
is kept; a page_id that repeats gives one record a row, of which at most one is the response. Control characters and
blanks of a url are percent-encoded in its header, and the url as it was is kept beside it as a JSON string. An empty
table gives no archive and an empty result; other columns of pages are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framelake.session import staged

SKIPPABLE, MAGIC = 0x184D2A5D, b"\x28\xb5\x2f\xfd"
DICTIONARY_BYTES, DICTIONARY_SAMPLES, DICTIONARY_SAMPLE_BYTES = 65_536, 512, 16_384
ARCHIVE_BYTES = 4 << 20
DATE = "1970-01-01T00:00:00Z"
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, nth: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'{page_id}:{nth}')}>"


def _target(url: str) -> list[tuple[str, str]]:
    """Headers of a url: as a header may hold it and, where that differs, as it is."""
    plain = "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url)
    return [("WARC-Target-URI", plain)] + ([("X-Target-URI", json.dumps(url))] if plain != url else [])


def _record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = "".join(f"{k}: {v}\r\n" for k, v in headers)
    return f"WARC/1.1\r\n{lines}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def _response(url: str, page_id: int | None, nth: int, payload: bytes, digest: str) -> bytes:
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    return _record([("WARC-Type", "response"), ("WARC-Record-ID", record_id(page_id, nth)), ("WARC-Date", DATE), *_target(url), ("WARC-Payload-Digest", f"sha1:{digest}"), ("X-Page-Id", json.dumps(page_id)), ("X-Payload-Length", str(len(payload))), ("Content-Type", "application/http; msgtype=response")], http + payload)


def _revisit(url: str, page_id: int | None, nth: int, size: int, digest: str, refers_to: int | None) -> bytes:
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    return _record([("WARC-Type", "revisit"), ("WARC-Record-ID", record_id(page_id, nth)), ("WARC-Date", DATE), *_target(url), ("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", record_id(refers_to, 1)), ("X-Refers-To-Page", json.dumps(refers_to)), ("X-Page-Id", json.dumps(page_id)), ("X-Payload-Length", str(size)), ("Content-Type", "application/http; msgtype=response")], http)


def dictionary(responses: DataFrame) -> bytes:
    """A dictionary trained on a bounded sample of distinct payloads, or of the samples where they are too little to train on.

    The sample is read through a bound on the digest that lets about twice its rows pass, so no task sends many.
    """
    total = responses.agg(F.approx_count_distinct("digest").alias("n")).first().n
    bound = min(1 << 32, (2 * DICTIONARY_SAMPLES << 32) // max(1, total))
    near = responses.where(F.conv(F.substring("digest", 1, 8), 16, 10).cast("long") < bound)
    rows = near.dropDuplicates(["digest"]).orderBy("digest").limit(DICTIONARY_SAMPLES).select(F.substring("payload", 1, DICTIONARY_SAMPLE_BYTES).alias("p")).collect()
    samples = [_response("https://example.org/", 0, 1, bytes(r.p), base32_sha1(bytes(r.p))) for r in rows]
    try:
        return zstandard.train_dictionary(min(DICTIONARY_BYTES, max(256, sum(map(len, samples)) // 8)), samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[-DICTIONARY_BYTES:]


def write(pages: DataFrame, min_revisit_bytes: int = 0) -> DataFrame:
    """archive, content: the archives of pages (page_id, url, html), one row each, staged in the shared folder."""
    payload = F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "utf-8")
    page = F.col("page_id").cast("long")
    at = (F.coalesce(page, F.lit(0)).alias("at"), page.isNull().alias("unnamed"), F.sha1(payload).alias("digest"))
    read = pages.select(page.alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), payload.alias("payload"), *at)
    keyed = read.select("page_id", "at", "unnamed", "digest", F.octet_length("payload").alias("size")).where(F.col("size") >= min_revisit_bytes)
    firsts = keyed.groupBy("digest").agg(F.min(F.struct("page_id")).alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")
    several = keyed.select("at", "unnamed", "digest").distinct().join(firsts, "digest")
    rows = read.join(several, ["at", "unnamed", "digest"], "left")
    # rows of one page_id and payload are numbered: only the first of the smallest is the response
    numbered = rows.withColumn("nth", F.row_number().over(Window.partitionBy("at", "unnamed", "digest").orderBy("url")))
    own = F.col("first").isNull() | (F.col("page_id").eqNullSafe(F.col("first.page_id")) & (F.col("nth") == 1))
    ready = numbered.select("page_id", "url", "digest", "nth", F.octet_length("payload").alias("size"), own.alias("own"), F.col("first.page_id").alias("refers_to"), F.when(own, F.col("payload")).alias("payload"))
    learned = dictionary(read.select("digest", "payload"))

    def archive(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        packer = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(learned) if learned else None, write_content_size=True)
        head = struct.pack("<II", SKIPPABLE, len(learned)) + learned if learned else b""
        parts, size, started = [head], len(head), False
        for pdf in batches:
            for r in pdf.itertuples():
                page = None if pd.isna(r.page_id) else int(r.page_id)
                digest = base64.b32encode(bytes.fromhex(r.digest)).decode()
                raw = _response(r.url, page, r.nth, r.payload, digest) if r.own else _revisit(r.url, page, r.nth, r.size, digest, None if pd.isna(r.refers_to) else int(r.refers_to))
                parts.append(packer.compress(raw))
                size, started = size + len(parts[-1]), True
                if size >= ARCHIVE_BYTES:
                    yield pd.DataFrame([[uuid.uuid4().hex, b"".join(parts)]], columns=["archive", "content"])
                    parts, size, started = [head], len(head), False
        if started:
            yield pd.DataFrame([[uuid.uuid4().hex, b"".join(parts)]], columns=["archive", "content"])

    return staged(ready.mapInPandas(archive, "archive string, content binary"), "warc")


def records(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of one archive."""
    at, learned = 0, None
    if content[:4] == struct.pack("<I", SKIPPABLE):
        size = struct.unpack_from("<I", content, 4)[0]
        learned, at = zstandard.ZstdCompressionDict(content[8 : 8 + size]), 8 + size
    view = memoryview(content)
    while at < len(content):
        unpacker = zstandard.ZstdDecompressor(dict_data=learned).decompressobj() if learned else zstandard.ZstdDecompressor().decompressobj()
        out = [unpacker.decompress(view[at:])]
        at = len(content) - len(unpacker.unused_data)
        head, _, rest = b"".join(out).partition(b"\r\n\r\n")
        headers = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
        yield headers, rest[: int(headers["Content-Length"])]


def read_back(archives: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, url of every record; digests of responses are taken from their payload."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for content in pdf["content"]:
                out = []
                for h, block in records(content):
                    payload = block.partition(b"\r\n\r\n")[2]
                    own = h["WARC-Type"] == "response"
                    digest = base32_sha1(payload) if own else h["WARC-Payload-Digest"].removeprefix("sha1:")
                    if own and digest != h["WARC-Payload-Digest"].removeprefix("sha1:"):
                        raise ValueError(f"digest of {h['WARC-Record-ID']} differs from its payload")
                    out.append((json.loads(h["X-Page-Id"]), len(payload) if own else int(h["X-Payload-Length"]), digest, h["WARC-Type"], json.loads(h.get("X-Refers-To-Page", "null")), json.loads(h["X-Target-URI"]) if "X-Target-URI" in h else h["WARC-Target-URI"]))
                yield pd.DataFrame(out, columns=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"]).astype({"page_id": "Int64", "refers_to": "Int64"})

    return archives.mapInPandas(read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string")
