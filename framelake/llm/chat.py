"""Chat formatting with offset-aligned loss masks.

A conversation is rendered whole: for each turn a header line with the role, the text, and an end mark. Control
strings of the template inside texts and roles are escaped with a backslash, and backslashes are doubled, so an
unescaped control string is the template's own and reading back is exact. The rendering is encoded once, with
the character offsets of its tokens. The spans of the learned turns are sorted as they come and meet the token
spans by binary search; that gives the tokens under the loss mask.

Null texts and roles are empty; turns come in the order of (turn, role, text), nulls first; repeated rows are
turns of their own; a null conv_id is a conversation; an empty table gives an empty result; other columns are
ignored. The rows of a conversation become one row, as its text is one value.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HEAD, TURN_END = "### ", "</turn>\n"
LEARNED = "assistant"
VOCABULARY = "byte_bpe_50k.json"
#: Conversations of one output batch.
AT_ONCE = 256
_ESCAPES = re.compile(r"\\|###|</turn>")
_ESCAPED = re.compile(r"\\(\\|###|</turn>|n)")
#: The end of a turn: an end mark after an even number of backslashes.
_END = re.compile(r"(?<!\\)(?:\\\\)*(</turn>\n)")


def escape(text: str) -> str:
    return _ESCAPES.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: "\n" if m[1] == "n" else m[1], text)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted text and the [start, end) spans of the learned turns' texts."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = HEAD + escape(role).replace("\n", "\\n") + "\n", escape(text)
        if role == LEARNED:
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, TURN_END]
        at += len(head) + len(body) + len(TURN_END)
    return "".join(parts), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted text: render() undone."""
    turns, at = [], 0
    while at < len(formatted):
        line = formatted.index("\n", at)
        end = _END.search(formatted, line + 1)
        turns.append((unescape(formatted[at + len(HEAD) : line]), unescape(formatted[line + 1 : end.start(1)])))
        at = end.end()
    return turns


def under_mask(spans: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    """[first, last) token of each span: those that share a character with it. Both are sorted [start, end) pairs."""
    first = np.searchsorted(tokens[:, 1], spans[:, 0], side="right")
    last = np.searchsorted(tokens[:, 0], spans[:, 1], side="left")
    return np.stack([first, np.maximum(first, last)], axis=1)


@lru_cache(maxsize=4)
def _tokenizer(name: str):
    import public_tokenizers
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallel part
    out = Tokenizer.from_file(public_tokenizers.path(name))
    out.no_truncation()
    out.no_padding()
    out.encode_special_tokens = True
    return out


def _pairs(values) -> np.ndarray:
    return np.array([list(v) for v in values], np.int64).reshape(-1, 2)


def formatted(rows: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """conv_id, formatted, n_tokens, mask (learned [first, last) tokens), loss_spans ([start, end) characters).

    loss_spans are where the masked tokens lie, clipped to the turns: a token across a border counts for its part.
    """
    blank = F.lit("")
    turns = F.struct(F.col("turn").alias("turn"), F.coalesce(F.col("role").cast("string"), blank).alias("role"), F.coalesce(F.col("text").cast("string"), blank).alias("text"))
    talks = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(turns)).alias("turns"))

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = _tokenizer(vocabulary)
        for pdf in batches:
            for lo in range(0, len(pdf), AT_ONCE):
                some = pdf.iloc[lo : lo + AT_ONCE]
                out = []
                for turns in some["turns"]:
                    text, spans = render([(x["role"], x["text"]) for x in turns])
                    spans, tokens = _pairs(spans), _pairs(t.encode(text, add_special_tokens=False).offsets)
                    mask = under_mask(spans, tokens)
                    loss = [(max(a, tokens[i, 0]), min(b, tokens[j - 1, 1])) if j > i else (a, a) for (a, b), (i, j) in zip(spans, mask, strict=True)]
                    out.append((text, len(tokens), mask.tolist(), _pairs(loss).tolist()))
                yield pd.DataFrame(out, columns=["formatted", "n_tokens", "mask", "loss_spans"]).assign(conv_id=some["conv_id"].to_numpy())

    kind = rows.schema["conv_id"].dataType.simpleString()
    return talks.mapInPandas(encode, f"conv_id {kind}, formatted string, n_tokens long, mask array<array<long>>, loss_spans array<array<long>>").select("conv_id", "formatted", "n_tokens", "mask", "loss_spans")


def digests(rendered: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_tokens, n_loss_tokens: read back from formatted()."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.itertuples():
                turns = parse(r.formatted)
                said = "".join(f"{role}\n{text}\n" for role, text in turns)
                loss = "".join(unescape(r.formatted[a:b]) for a, b in r.loss_spans)
                out.append((len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(r.formatted), r.n_tokens, sum(int(j - i) for i, j in r.mask)))
            yield pd.DataFrame(out, columns=["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_tokens", "n_loss_tokens"]).assign(conv_id=pdf["conv_id"].to_numpy())

    kind = rendered.schema["conv_id"].dataType.simpleString()
    schema = f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long, n_loss_tokens long"
    return rendered.mapInPandas(read, schema)
