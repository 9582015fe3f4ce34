"""Exact byte-pair encoding by dynamic programming over prefixes.

Every prefix of a pre-token has exactly one valid encoding, hence one valid last token: the token ``t`` for which
the prefix before it ends in ``u`` and the pair (u, t) encodes to itself. A table of these last tokens therefore
holds the encodings of all prefixes at once. Appending continues the table; an edit recomputes it from the
pre-token that holds the first changed character until the pre-tokens agree again. Reading the table backwards
gives the ids.

Workers keep the vocabulary, the validity of token pairs and the ids of frequent pre-tokens in bounded caches;
emptying a cache never changes a result.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

PAIR_CACHE = 2_000_000
WORD_CACHE = 400_000


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


class Encoder:
    """Encoder of one byte-level vocabulary (a file of base64 token and rank per line) and pre-token pattern."""

    def __init__(self, path: str, pattern: str) -> None:
        with open(path, "rb") as f:
            self.ids = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self.tokens = {i: t for t, i in self.ids.items()}
        self.words = regex.compile(pattern)
        #: Longest token that ends in each byte: bounds the candidates per position.
        self.reach = [0] * 256
        for token in self.ids:
            self.reach[token[-1]] = max(self.reach[token[-1]], len(token))
        self.pairs: dict[tuple[int, int], bool] = {}
        self.known: dict[str, list[int]] = {}

    def _merge(self, raw: bytes) -> list[bytes]:
        """Encoding by definition: join the adjacent pair of least rank until none is left. Used on token pairs."""
        parts = [raw[i : i + 1] for i in range(len(raw))]
        while len(parts) > 1:
            ranks = [self.ids.get(a + b, 1 << 60) for a, b in zip(parts, parts[1:])]
            least = min(ranks)
            if least == 1 << 60:
                break
            at = ranks.index(least)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _fits(self, before: int, token: int) -> bool:
        """Do the two tokens side by side encode to themselves? ``before`` is -1 at the start."""
        key = (before, token)
        ok = self.pairs.get(key)
        if ok is None:
            own = self.tokens[token]
            ok = self._merge(own) == [own] if before < 0 else self._merge(self.tokens[before] + own) == [self.tokens[before], own]
            if len(self.pairs) >= PAIR_CACHE:
                self.pairs.clear()
            self.pairs[key] = ok
        return ok

    def extend(self, raw: bytes, last: list[int]) -> list[int]:
        """Continue the table ``last`` (last[n] = last token of the prefix of n bytes; last[0] = -1) to all of ``raw``."""
        ids, fits, reach = self.ids, self._fits, self.reach
        sizes = [0] + [len(self.tokens[t]) for t in last[1:]]
        for end in range(len(last), len(raw) + 1):
            for size in range(min(end, reach[raw[end - 1]]), 0, -1):
                token = ids.get(raw[end - size : end])
                if token is not None and fits(last[end - size], token):
                    last.append(token)
                    sizes.append(size)
                    break
            else:  # cannot happen while every byte is a token
                raise ValueError("no valid last token")
        return last

    def read(self, last: list[int]) -> list[int]:
        out, n = [], len(last) - 1
        while n:
            out.append(last[n])
            n -= len(self.tokens[last[n]])
        return out[::-1]

    def word(self, word: str) -> list[int]:
        got = self.known.get(word)
        if got is None:
            raw = word.encode("utf-8", "replace")
            whole = self.ids.get(raw)
            got = [whole] if whole is not None and self._fits(-1, whole) else self.read(self.extend(raw, [-1]))
            if len(self.known) >= WORD_CACHE:
                self.known.clear()
            self.known[word] = got
        return got

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text without special tokens; null and '' give []."""
        if not text:
            return []
        out: list[int] = []
        word, known = self.word, self.known
        for w in self.words.findall(text):
            out += known.get(w) or word(w)
        return out


class Prefixes:
    """The encoded state of one growing text: exact appends and re-encoding near edits."""

    def __init__(self, encoder: Encoder, text: str = "") -> None:
        self.encoder, self.text = encoder, ""
        self.spans: list[tuple[int, int]] = []
        self.tables: list[list[int]] = []
        self.reused = 0
        self.replace(0, 0, text)

    def append(self, text: str) -> None:
        self.replace(len(self.text), len(self.text), text)

    def replace(self, start: int, end: int, text: str) -> None:
        """Put ``text`` in the place of characters start..end; only pre-tokens near the edit are worked out again."""
        old_spans, old_tables, old = self.spans, self.tables, self.text
        self.text = old[:start] + text + old[end:]
        shift = len(text) - (end - start)
        # A pre-token may look one character ahead and swallow its neighbour: step back two of them.
        keep = max(0, sum(1 for _, b in old_spans if b < start) - 2)
        spans, tables = old_spans[:keep], old_tables[:keep]
        at = spans[-1][1] if spans else 0
        later = {a + shift: i for i, (a, b) in enumerate(old_spans) if a >= end}
        self.reused = keep
        for m in self.encoder.words.finditer(self.text, at):
            same = later.get(m.start())
            if same is not None and m.start() > start + len(text) and old_spans[same][1] + shift == m.end():
                tail = [(a + shift, b + shift) for a, b in old_spans[same:]]
                spans, tables = spans + tail, tables + old_tables[same:]
                self.reused += len(tail)
                break
            raw = m.group().encode("utf-8", "replace")
            table = [-1]
            if len(spans) < len(old_spans) and old_spans[len(spans)][0] == m.start() <= start:
                before = old[m.start() : old_spans[len(spans)][1]]
                share = 0
                for x, y in zip(before, m.group()):
                    if x != y:
                        break
                    share += 1
                table = old_tables[len(spans)][: len(m.group()[:share].encode("utf-8", "replace")) + 1]
            spans.append(m.span())
            tables.append(self.encoder.extend(raw, list(table)))
        self.spans, self.tables = spans, tables

    def ids(self) -> list[int]:
        return [i for t in self.tables for i in self.encoder.read(t)]


_ENCODERS: dict[tuple[str, str], Encoder] = {}


def encoder(path: str | None = None, pattern: str | None = None) -> Encoder:
    key = (path or default_vocabulary(), pattern or default_pattern())
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(*key)
    return _ENCODERS[key]


def encode(docs: DataFrame, key: str, text: str, path: str | None = None, pattern: str | None = None, count_only: bool = False) -> DataFrame:
    """(key, ids array<int>) of every row, or (key, n_tokens long) with ``count_only``.

    Rows keep their number and partition; null and empty texts have no ids (an empty list, 0 tokens).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path, pattern)
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                part = b.slice(at, 1000)
                ids = [own.encode(t) for t in part.column(1).to_pylist()]
                made = pa.array([len(i) for i in ids], pa.int64()) if count_only else pa.array(ids, pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), made], [key, "n_tokens" if count_only else "ids"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(docs[key], docs[text]).mapInArrow(run, f"`{key}` {kind}, " + ("n_tokens long" if count_only else "ids array<int>"))
