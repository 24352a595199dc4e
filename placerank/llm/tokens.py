"""Exact token counts of every prefix of a text, by dynamic programming.

Byte-pair encoding works within the pieces that a fixed pattern cuts from a text.
For each prefix of a piece there is exactly one vocabulary entry that ends the
prefix's encoding: the one which, after the last entry of the shorter prefix that
it extends, is what encoding the two together gives.  So one pass from left to
right stores the count of every prefix, from those of shorter prefixes, and a
question about any truncation or budget is an array lookup, not an encoding.
Tables of pieces are kept per task, as most pieces occur again.
"""

from __future__ import annotations

import functools
import json
import re
from collections.abc import Iterable

import numpy as np
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from placerank.llm.common import Texts, map_texts

# The pattern of pieces, and the endings it cuts off as a whole.
PIECES = regex.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
)
_SPLIT_ENDINGS = ("'re", "'ve", "'ll")
_BLANKS = regex.compile(r"\s+")
_KEPT_TABLES, _KEPT_JOINS = 300_000, 400_000


def byte_letters() -> dict[str, int]:
    """The printable letters that stand for bytes in the vocabulary file.

    Printable bytes stand for themselves; the others follow from 256 on, in order.
    """
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(hidden)}


class PrefixCounter:
    """Token counts of prefixes under a byte-level BPE vocabulary file."""

    def __init__(self, vocabulary: str):
        with open(vocabulary, encoding="utf-8") as file:
            stored = json.load(file)
        letters = byte_letters()

        def raw(token: str) -> bytes:
            return bytes(letters[c] for c in token)

        self.special = [t["content"] for t in stored["added_tokens"]]
        self._at_special = (
            re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        )
        known = {t: i for t, i in stored["model"]["vocab"].items() if t not in self.special}
        self.ids = {raw(t): i for t, i in known.items()}
        self.longest = max(map(len, self.ids))
        self.merges = {}
        for rank, pair in enumerate(stored["model"]["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.merges[(raw(left), raw(right))] = rank
        self._joins: dict[tuple[bytes, bytes], bool] = {}
        self._tables: dict[str, bytes] = {}
        self._older: dict[str, bytes] = {}
        self._long: tuple[int, ...] = ()

    def merged(self, text: bytes) -> list[bytes]:
        """The merges applied in the order of their ranks; for two entries at a time."""
        parts = [text[i : i + 1] for i in range(len(text))]
        ranks = self.merges
        while len(parts) > 1:
            best, at = min(
                (ranks.get((parts[i], parts[i + 1]), len(ranks)), i) for i in range(len(parts) - 1)
            )
            if best == len(ranks):
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def joins(self, last: bytes, entry: bytes) -> bool:
        """Whether ``entry`` may follow ``last``: together they encode to just these two."""
        pair = (last, entry)
        found = self._joins.get(pair)
        if found is None:
            if len(self._joins) >= _KEPT_JOINS:
                self._joins.clear()
            found = self.merged(last + entry) == ([last, entry] if last else [entry])
            self._joins[pair] = found
        return found

    def table(self, piece: str) -> bytes | tuple[int, ...]:
        """Tokens of every code point prefix of a piece, the empty one left out."""
        found = self._tables.get(piece) or self._older.get(piece)
        if found is None:
            self.learn([piece])
            found = self._tables.get(piece) or self._long
        return found

    def learn(self, pieces: Iterable[str]) -> None:
        """Tables of new pieces; sorted, each goes on from what it shares with the one before."""
        text, counts, last = b"", [0], [b""]
        ids, joins, longest = self.ids, self.joins, self.longest
        for piece in sorted(pieces):
            before, text = text, piece.encode("utf-8", "surrogatepass")
            n, shared = len(text), 0
            for x, y in zip(before, text, strict=False):
                if x != y:
                    break
                shared += 1
            del counts[shared + 1 :], last[shared + 1 :]
            for end in range(shared + 1, n + 1):
                for start in range(max(0, end - longest), end):
                    entry = text[start:end]
                    if entry in ids and joins(last[start], entry):
                        counts.append(counts[start] + 1)
                        last.append(entry)
                        break
            ends = [i for i in range(1, n) if text[i] & 0xC0 != 0x80] + [n]
            if len(piece) < 64:
                if len(self._tables) >= _KEPT_TABLES:
                    self._older, self._tables = self._tables, {}
                self._tables[piece] = bytes([counts[i] for i in ends])
            else:
                self._long = tuple(counts[i] for i in ends)

    def _known(self, piece: str) -> bool:
        if piece in self._tables:
            return True
        found = self._older.get(piece)
        if found is not None and len(self._tables) < _KEPT_TABLES:
            self._tables[piece] = found
        return found is not None

    def totals(self, texts: list[str]) -> list[int]:
        """Tokens of whole texts: the last entries of the tables of their pieces."""
        cut = [
            [1 if i % 2 else PIECES.findall(s) for i, s in enumerate(self._segments(t))] for t in texts
        ]
        seen = {p for parts in cut for part in parts if part != 1 for p in part}
        self.learn([p for p in seen if len(p) < 64 and not self._known(p)])
        get, table = self._tables.get, self.table
        return [
            sum(
                1 if part == 1 else sum((get(p) or table(p))[-1] for p in part) for part in parts
            )
            for parts in cut
        ]

    def _segments(self, text: str) -> Iterable[str]:
        return self._at_special.split(text) if self._at_special else (text,)

    def count(self, text: str) -> int:
        return self.totals([text])[0]

    def prefixes(self, text: str) -> np.ndarray:
        """Tokens of ``text[:i]`` for every ``i`` from 0 to its length.

        Where a cut changes how the pattern would divide the end, the count is that
        of the text cut there: in white space, within an ending, and within the name
        of a special token.
        """
        counts = np.zeros(len(text) + 1, dtype=np.int32)
        start = 0
        for i, segment in enumerate(self._segments(text)):
            if i % 2:
                self._within_special(text, start, segment, counts)
            else:
                self._within_segment(segment, counts[start : start + len(segment) + 1])
            start += len(segment)
        return counts

    def _within_segment(self, segment: str, counts: np.ndarray) -> None:
        base = int(counts[0])
        for found in PIECES.finditer(segment):
            start, end = found.span()
            table = self.table(found.group())
            counts[start + 1 : end + 1] = list(table)
            counts[start + 1 : end + 1] += base
            if found.group() in _SPLIT_ENDINGS:
                counts[start + 2] = base + 2
            base += table[-1]
        for found in _BLANKS.finditer(segment):
            start, end = found.span()
            if end - start > 1:
                last = counts[end]
                counts[start + 1 : end + 1] = list(self.table(found.group()))
                counts[start + 1 : end + 1] += counts[start]
                if end == len(segment):
                    counts[end] = last

    def _within_special(self, text: str, start: int, name: str, counts: np.ndarray) -> None:
        begun = max(0, max(text.rfind(s, 0, start) + len(s) if s in text[:start] else 0 for s in self.special))
        for cut in range(1, len(name)):
            counts[start + cut] = counts[begun] + self.count(text[begun:start] + name[:cut])
        counts[start + len(name)] = counts[start] + 1


@functools.lru_cache(maxsize=2)
def counter_of(vocabulary: str) -> PrefixCounter:
    """One counter per worker process, so that its tables outlive a task."""
    return PrefixCounter(vocabulary)


RESULTS = T.StructType(
    [
        T.StructField("n_bytes", T.LongType()),
        T.StructField("n_tokens", T.LongType()),
        T.StructField("over_limit", T.BooleanType()),
    ]
)
PREFIXES = T.StructField("prefix_tokens", T.ArrayType(T.IntegerType()))


def count_tokens(
    docs: DataFrame,
    vocabulary: str,
    limit: int = 1024,
    text: str = "text",
    keep: list[str] | None = None,
    prefixes: bool = False,
) -> DataFrame:
    """``docs`` with ``n_bytes``, ``n_tokens`` and ``over_limit``.

    ``vocabulary`` is the path of a byte-level BPE file, which every worker can
    read.  With ``prefixes`` each row also gets ``prefix_tokens``: entry ``i`` is the
    exact count of the first ``i`` characters, for ``fitting_prefix`` and
    ``tokens_before``.  Names of special tokens inside texts count as that token.

    Null text counts as empty: 0 bytes, 0 tokens.  Rows are independent, so ties and
    repeated rows need no rule; columns of the input with a result's name are replaced.
    """

    def factory():
        counter = counter_of(vocabulary)

        def work(texts: Texts):
            n_bytes = np.array([len(t or b"") for t in texts], dtype=np.int64)
            plain = [(t or b"").decode("utf-8", "replace") for t in texts]
            if not prefixes:
                n_tokens = np.array(counter.totals(plain), dtype=np.int64)
                return n_bytes, n_tokens, n_tokens > limit
            tables = [counter.prefixes(t) for t in plain]
            n_tokens = np.array([t[-1] for t in tables], dtype=np.int64)
            return n_bytes, n_tokens, n_tokens > limit, [t.tolist() for t in tables]

        return work

    results = T.StructType([*RESULTS.fields, PREFIXES]) if prefixes else RESULTS
    return map_texts(docs, text, docs.columns if keep is None else keep, results, factory)


def tokens_before(position: Column, table: str = "prefix_tokens") -> Column:
    """Tokens of the first ``position`` characters, from the stored table."""
    return F.get(F.col(table), position.cast("int"))


def fitting_prefix(budget: Column, table: str = "prefix_tokens") -> Column:
    """Characters of the longest prefix with at most ``budget`` tokens, from the table."""
    inside = F.transform(F.col(table), lambda n, i: F.when(n <= budget, i))
    return F.array_max(inside)
