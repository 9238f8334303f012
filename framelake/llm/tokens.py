"""Token counts at every prefix of a text, for BPE vocabularies that mark word ends and drop white space.

A BPE tokenizer never merges across the pieces that its pre-tokenizer cuts, so the number of tokens of a prefix
is a sum that runs along the pieces: count(text[:i]) = count(text[:s]) + count(text[s:i]), s being the start of
the piece that holds i. Inside a piece the same sum runs along its words and signs, and each of these has a row with
the count of every prefix, by dynamic programming over its letters: tokens follow each other in an encoding if, and only
if, each two neighbours do, so the last token of a prefix is the one that may follow the last token of what precedes it,
and the count is one more than there. A row takes time in proportion to the word, whatever its length. So the tables
answer, to the character, how long a text is, what it costs to cut it at a place, and how much of it a budget buys,
without encoding the text again. Whole pieces repeat, so each worker keeps their counts, as the library gives them, and
the rows of those that a cut has fallen into. Words with letters that lower case turns into several, and pieces that
are not composed or hold a `<`, are counted by the library prefix by prefix.

Null and empty texts have 0 tokens. A text is handled whole, whatever its length; rows are independent, so repeated
rows give a row each and an empty table an empty result; other columns of docs are ignored.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelake.llm.arrowtext import slices

#: Pieces of one worker's cache; beyond it the cache starts afresh.
CACHED_PIECES = 1 << 20
PIECES_AT_ONCE = 4096
#: What Unicode calls white space: the tokenizer makes one blank of it and drops that, so pieces end there.
_SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
SPACES = frozenset(chr(c) for c in range(0x3001) if re.match(f"[{_SPACE}]", chr(c)))
#: The words and signs that the vocabulary's pre-tokenizer cuts pieces into.
PARTS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+", regex.IGNORECASE)
PIECES, WORDS, SEPARATORS = re.compile(f"[{_SPACE}]+|[^{_SPACE}]+"), re.compile(f"[^{_SPACE}]+"), re.compile("[\\x1c-\\x1f]")


class Merges:
    """A vocabulary's merges: which tokens may follow which."""

    def __init__(self, model: dict):
        self.suffix = model.get("end_of_word_suffix") or ""
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.ranks = {p: k for k, p in enumerate(pairs)}
        self.vocab = model["vocab"]
        self.longest = max(len(t.removesuffix(self.suffix) if self.suffix else t) for t in self.vocab)
        plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
        other = [b for b in range(256) if b not in set(plain)]
        self.letters = [chr(b) for b in range(256)]
        for k, b in enumerate(other):
            self.letters[b] = chr(256 + k)
        self.follow: dict[tuple[str, str, bool], bool] = {}

    def merged(self, symbols: list[str]) -> list[str]:
        """Symbols after all merges, those of the least rank first."""
        while len(symbols) > 1:
            best = min(range(len(symbols) - 1), key=lambda i: (self.ranks.get((symbols[i], symbols[i + 1]), len(self.ranks)), i))
            if (symbols[best], symbols[best + 1]) not in self.ranks:
                break
            symbols[best : best + 2] = [symbols[best] + symbols[best + 1]]
        return symbols

    def follows(self, before: str, token: str, end: bool) -> bool:
        """Whether token, at a word's end or not, may follow before (empty: stand first)."""
        key = (before, token, end)
        if key not in self.follow:
            if len(self.follow) > CACHED_PIECES:
                self.follow.clear()
            symbols = [*before, *token]
            if end:
                symbols[-1] += self.suffix
            said = token + self.suffix if end else token
            self.follow[key] = self.merged(symbols) == ([before, said] if before else [said])
        return self.follow[key]

    def prefix_counts(self, data: bytes) -> list[int]:
        """The number of tokens of data[:j] as a word, for each j; within a character it is that of its bytes so far."""
        text = "".join(self.letters[b] for b in data)
        counts, last, whole = [0], [""], [0]  # of prefixes that go on, and their last tokens; of prefixes that end
        for j in range(1, len(text) + 1):
            inner = outer = None
            for s in range(max(0, j - self.longest), j):
                token = text[s:j]
                if inner is None and token in self.vocab and self.follows(last[s], token, False):
                    inner = s
                if outer is None and token + self.suffix in self.vocab and self.follows(last[s], token, True):
                    outer = s
                if inner is not None and outer is not None:
                    break
            counts.append(counts[inner] + 1)
            last.append(text[inner:j])
            whole.append(counts[outer] + 1)
        return whole


class PrefixCounter:
    """Counts of tokens by the library's tokenizer file (.json), without special tokens added."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        if self.encoded(" a  b ") != self.encoded("a") + self.encoded("b") or self.encoded(" "):
            raise ValueError("counting by pieces needs a vocabulary that drops white space")
        with open(path, encoding="utf-8") as f:
            self.merges = Merges(json.load(f)["model"])
        self.counts: dict[str, int] = {}
        self.rows: dict[str, list[int]] = {}
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, sorted(self.specials, key=len, reverse=True)))) if self.specials else None

    def encoded(self, text: str) -> int:
        return len(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _missing(self, pieces: list[str]) -> None:
        """Count the pieces not seen before: encoded as one text, each token goes to the piece that it starts in."""
        if len(self.counts) > CACHED_PIECES:
            self.counts.clear()
        new = list(set(pieces).difference(self.counts))
        for lo in range(0, len(new), PIECES_AT_ONCE):
            some = new[lo : lo + PIECES_AT_ONCE]
            starts = np.cumsum([0, *(len(p) + 1 for p in some)])
            tokens = [x for x, _ in self.tokenizer.encode_batch([" ".join(some)], add_special_tokens=False)[0].offsets]
            each = np.bincount(np.searchsorted(starts, tokens, side="right") - 1, minlength=len(some)) if tokens else [0] * len(some)
            self.counts.update(zip(some, map(int, each), strict=True))

    def _split(self, text: str) -> list[str]:
        # str.split() also cuts at the four separators that are no white space for the library
        return WORDS.findall(text) if SEPARATORS.search(text) else text.split()

    def count(self, text: str | None) -> int:
        """Tokens of the whole text."""
        if not text:
            return 0
        if self.special is not None and any(s in text for s in self.specials):
            return sum(self._plain_count(part) for part in self.special.split(text)) + len(self.special.findall(text))
        return self._plain_count(text)

    def _plain_count(self, text: str) -> int:
        pieces = self._split(text)
        try:
            return sum(map(self.counts.__getitem__, pieces))
        except KeyError:
            self._missing(pieces)
            return sum(map(self.counts.__getitem__, pieces))

    def learn(self, texts: list[str]) -> None:
        """Make the pieces of many texts known at once."""
        seen: set[str] = set()
        for text in texts:
            seen.update(set(self._split(text)).difference(self.counts))
        self._missing(list(seen))

    def prefixes(self, text: str | None) -> tuple[list[int], list[int]]:
        """(ends, tokens): tokens[k] is the exact count of text[:ends[k]], for each piece end."""
        ends, each = [0], [0]
        for m in self._walk(text or ""):
            ends.append(m[1])
            each.append(m[2])
        return ends, list(accumulate(each))

    def _walk(self, text: str) -> Iterator[tuple[int, int, int]]:
        at = 0
        for m in self.special.finditer(text) if self.special is not None else ():
            yield from self._plain(text, at, m.start())
            yield m.start(), m.end(), 1
            at = m.end()
        yield from self._plain(text, at, len(text))

    def _plain(self, text: str, lo: int, hi: int) -> Iterator[tuple[int, int, int]]:
        found = [(m.start(), m.end()) for m in PIECES.finditer(text, lo, hi)]
        words = [text[a:b] for a, b in found]
        self._missing([w for w in words if w[0] not in SPACES])
        for (a, b), w in zip(found, words, strict=True):
            yield a, b, 0 if w[0] in SPACES else self.counts[w]

    def _row(self, part: str) -> list[int]:
        """The counts of all prefixes of a part, the empty one first."""
        if part not in self.rows:
            if len(self.rows) > CACHED_PIECES:
                self.rows.clear()
            plain = [c.lower() for c in part]
            if all(len(c) == 1 for c in plain) and unicodedata.is_normalized("NFC", part):
                ends = list(accumulate((len(c.encode()) for c in plain), initial=0))
                each = self.merges.prefix_counts("".join(plain).encode())
                self.rows[part] = [each[e] for e in ends]
            else:
                some = self.tokenizer.encode_batch([part[:j] for j in range(1, len(part) + 1)], add_special_tokens=False)
                self.rows[part] = [0, *(len(e.ids) for e in some)]
        return self.rows[part]

    def _parts(self, piece: str) -> list[tuple[int, str]]:
        """(start, part): where a piece can be cut without changing the tokens of either side."""
        if not unicodedata.is_normalized("NFC", piece):  # characters may unite across parts
            return [(0, piece)]
        return [(m.start(), m.group()) for m in PARTS.finditer(piece)]

    def _inside(self, piece: str, i: int) -> int:
        """The count of piece[:i]."""
        parts = self._parts(piece)
        k = bisect_right([a for a, _ in parts], i) - 1
        if k < 0:
            return 0
        if self.special is not None and "<" in piece:  # a prefix may end in a special string's beginning
            return self.encoded(piece[:i])
        self._missing([p for _, p in parts[:k]])
        start, part = parts[k]
        return sum(self.counts[p] for _, p in parts[:k]) + self._row(part)[i - start]

    def _reach(self, piece: str, budget: int) -> int:
        """The largest i with at most budget tokens in piece[:i]."""
        parts = self._parts(piece)
        self._missing([p for _, p in parts])
        at, left = 0, budget
        for start, part in parts:
            if self.counts[part] <= left:
                left -= self.counts[part]
                at = start + len(part)
                continue
            return start + max(j for j, n in enumerate(self._row(part)) if n <= left)
        return at

    def at(self, text: str, i: int) -> int:
        """The count of text[:i], from the tables of the text and of the piece that i falls in."""
        ends, tokens = self.prefixes(text)
        k = bisect_right(ends, i) - 1
        return tokens[k] + (self._inside(text[ends[k] : ends[k + 1]], i - ends[k]) if i > ends[k] else 0)

    def within(self, text: str, budget: int) -> int:
        """The largest i with at most budget tokens in text[:i] and in what precedes the piece that i falls in."""
        ends, tokens = self.prefixes(text)
        k = bisect_right(tokens, budget) - 1
        if k == len(ends) - 1 or (piece := text[ends[k] : ends[k + 1]]) in self.specials:
            return ends[k]
        return ends[k] + self._reach(piece, budget - tokens[k])


@lru_cache(maxsize=4)
def counter(name: str) -> PrefixCounter:
    import public_tokenizers

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallel part
    return PrefixCounter(public_tokenizers.path(name))


def token_counts(docs: DataFrame, vocabulary: str = "word_bpe_49k.json", limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit, and cut_chars: the code points that limit tokens buy, of each row of docs."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(vocabulary)
        for batch in slices(batches):
            texts = batch.column("text").to_pylist()
            c.learn(texts)
            tokens = [c.count(t) for t in texts]
            cuts = [c.within(t, limit) if n > limit else len(t) for t, n in zip(texts, tokens, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens]), pa.array(cuts, pa.int64())], ["doc_id", "n_bytes", "n_tokens", "over_limit", "cut_chars"])

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    read = docs.select("doc_id", text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes"))
    kind = read.schema["doc_id"].dataType.simpleString()
    return read.mapInArrow(counted, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean, cut_chars long")
