"""Language identification by interpolated Kneser-Ney character models.

One model per language of the labels: probabilities of a letter after up to three
others, each order discounted and interpolated with the next shorter one, whose
counts are of distinct continuations.  A model is a set of sorted arrays of packed
letter sequences.  A text gets the language with the lowest cross-entropy per
letter.  It is rejected if that entropy is nearer to what other languages' texts have
under the model than to what the language's own have, with an allowance for short
texts; both are known exactly from the counts.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from placerank.llm.common import Texts, column, map_texts, pieces, small_batches
from placerank.sources.scratch import written

ORDER = 4
_BITS = 16
_BLANK = 32
_FLUSH = 2_000_000
_CACHE_BITS = 18
# Arrays of letters take some sixty times the bytes of their texts for a moment.
_PIECE_BYTES = 1 << 18
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
UNKNOWN = "und"


@functools.lru_cache(maxsize=1)
def _letters() -> tuple[np.ndarray, np.ndarray]:
    """Every code point as its lower-case letter, or a blank if it is no letter or mark; and
    whether it is a letter.

    Letters have 16 bits, so four of them fill one 64-bit number.  Those beyond U+FFFF share the
    6,400 places that Unicode leaves to private use, so none is taken for a blank or for another
    of the first 65,536.
    """
    table = np.full(0x110000, _BLANK, dtype=np.uint16)
    letters = np.zeros(0x110000, dtype=bool)
    for code in range(0x32400):
        letter = chr(code)
        kind = unicodedata.category(letter)[0]
        if kind in "LM":
            lower = ord(letter.lower()) if len(letter.lower()) == 1 else code
            table[code] = lower if lower <= 0xFFFF else 0xE000 + lower % 6400
            letters[code] = kind == "L"
    return table, letters


def letters_of(text: bytes | None) -> np.ndarray:
    """Letters of a text with one blank between words and none at the ends.

    Marks belong to the letters around them; a text of marks alone has none.
    """
    codes = np.frombuffer((text or b"").decode("utf-8", "replace").encode("utf-32-le"), dtype=np.uint32)
    table, letters = _letters()
    if not letters[codes].any():
        return np.zeros(0, dtype=np.uint64)
    found = table[codes]
    blank = found == _BLANK
    inside = ~blank
    inside[1:] |= ~blank[:-1]
    found = found[inside]
    return found[: -1 if len(found) and found[-1] == _BLANK else None].astype(np.uint64)


def sequences(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Packed sequences of four letters of all texts in turn, and how many each text has.

    A text starts after three blanks and ends with one.
    """
    lead, tail = np.full(ORDER - 1, _BLANK, np.uint64), np.full(1, _BLANK, np.uint64)
    parts, sizes = [], np.zeros(len(texts), dtype=np.int64)
    for i, text in enumerate(texts):
        found = letters_of(text)
        if len(found):
            parts += [lead, found, tail]
            sizes[i] = len(found) + 1
    if not parts:
        return np.zeros(0, dtype=np.uint64), sizes
    line = np.concatenate(parts)
    packed = line[: len(line) - ORDER + 1].copy()
    for k in range(1, ORDER):
        packed <<= np.uint64(_BITS)
        packed |= line[k : len(line) - ORDER + 1 + k]
    starts = np.cumsum(sizes[sizes > 0] + ORDER - 1) - (sizes[sizes > 0] + ORDER - 1)
    keep = np.ones(len(line), dtype=bool)
    for start in starts[1:]:
        keep[start - ORDER + 1 : start] = False
    return packed[keep[: len(packed)]], sizes


def count_sequences(labelled: DataFrame, text: str, lang: str) -> DataFrame:
    """``lang``, ``gram`` and ``n``: how often each sequence occurs in each language's texts."""
    source = labelled.select(column(lang).alias("lang"), column(text).cast("binary").alias("text"))

    def rows(lang: str, counts: list) -> pa.RecordBatch:
        grams, n = _added(counts)
        return pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(grams), pa.string()), pa.array(grams.view(np.int64)), pa.array(n)],
            names=["lang", "gram", "n"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        for batch in batches:
            for piece in pieces(batch, 1, _PIECE_BYTES):
                by_lang: dict[str, Texts] = {}
                for name, raw in zip(*(c.to_pylist() for c in piece.columns), strict=True):
                    by_lang.setdefault(name, []).append(raw)
                for name, texts in by_lang.items():
                    counts = held.setdefault(name, [])
                    counts.append(np.unique(sequences(texts)[0], return_counts=True))
                    if len(counts) >= 32:
                        held[name] = [_added(counts)]
            if sum(len(c[0]) for counts in held.values() for c in counts) > _FLUSH:
                yield from (rows(name, counts) for name, counts in held.items())
                held = {}
        yield from (rows(name, counts) for name, counts in held.items())

    counted = small_batches(source).mapInArrow(run, "lang string, gram long, n long")
    return counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _added(counts: list) -> tuple[np.ndarray, np.ndarray]:
    grams = np.concatenate([c[0] for c in counts])
    n = np.concatenate([c[1] for c in counts]).astype(np.int64)
    unique, at = np.unique(grams, return_inverse=True)
    return unique, np.bincount(at, weights=n).astype(np.int64)


def _sums(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    unique, at = np.unique(keys, return_inverse=True)
    return unique, np.bincount(at, weights=values)


def _find(keys: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of ``asked`` in sorted ``keys``, and whether they are there."""
    at = np.minimum(np.searchsorted(keys, asked), max(len(keys) - 1, 0))
    return at, keys[at] == asked if len(keys) else np.zeros(len(asked), dtype=bool)


@dataclass
class Model:
    """Sorted sequences of each length with log probabilities, and contexts with log weights."""

    letters: int
    grams: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)
    contexts: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)

    @classmethod
    def fit(cls, grams: np.ndarray, n: np.ndarray) -> Model:
        order = np.argsort(grams)
        levels = [(grams[order], n[order].astype(np.float64))]
        for k in range(ORDER - 1, 0, -1):
            mask = np.uint64((1 << (_BITS * k)) - 1)
            longer = levels[0][0]
            levels.insert(0, _sums(longer & mask, np.ones(len(longer))))
        model = cls(letters=len(levels[0][0]) + 1)
        for k, (keys, counts) in enumerate(levels, 1):
            ones, twos = (counts == 1).sum(), (counts == 2).sum()
            discount = float(np.clip(ones / max(ones + 2 * twos, 1), 0.1, 0.9))
            context = keys >> np.uint64(_BITS)
            names, totals = _sums(context, counts)
            _, followers = _sums(context, np.ones(len(keys)))
            at = np.searchsorted(names, context)
            weight = discount * followers / totals
            lower = model._shorter(keys, k)
            p = np.maximum(counts - discount, 0) / totals[at] + weight[at] * np.exp(lower)
            model.grams.append((keys, np.log(p).astype(np.float32)))
            model.contexts.append((names, np.log(weight).astype(np.float32)))
        return model

    def _shorter(self, grams: np.ndarray, k: int) -> np.ndarray:
        if k == 1:
            return np.full(len(grams), -np.log(self.letters))
        return self.log_p(grams & np.uint64((1 << (_BITS * (k - 1))) - 1), k - 1)

    def log_p(self, grams: np.ndarray, k: int = ORDER) -> np.ndarray:
        """Log probability of the last letter of each sequence after the ones before."""
        keys, known = self.grams[k - 1]
        at, there = _find(keys, grams)
        out = np.empty(len(grams))
        out[there] = known[at[there]]
        new = grams[~there]
        if len(new):
            names, weights = self.contexts[k - 1]
            where, seen = _find(names, new >> np.uint64(_BITS))
            out[~there] = self._shorter(new, k) + np.where(seen, weights[where], 0.0)
        return out


@dataclass
class Identifier:
    """Models of all languages, and the entropy from which a text is rejected."""

    langs: list[str]
    models: list[Model]
    limits: np.ndarray
    spreads: np.ndarray
    _keys: np.ndarray | None = None
    _scores: np.ndarray | None = None

    @classmethod
    def fit(cls, counts: dict[str, tuple[np.ndarray, np.ndarray]]) -> Identifier:
        langs = sorted(counts)
        models = [Model.fit(*counts[lang]) for lang in langs]
        limits, spreads = np.zeros(len(langs)), np.zeros(len(langs))
        for i, lang in enumerate(langs):
            own, foreign = 0.0, [np.log(models[i].letters)]
            for other in langs:
                grams, n = counts[other]
                cost = -models[i].log_p(grams)
                mean = float((cost * n).sum() / n.sum())
                if other == lang:
                    own = mean
                    spreads[i] = np.sqrt(float(((cost - mean) ** 2 * n).sum() / n.sum()))
                else:
                    foreign.append(mean)
            limits[i] = own + max(min(foreign) - own, 0.0) / 2
        return cls(langs, models, limits, spreads)

    def _log_p(self, grams: np.ndarray) -> np.ndarray:
        """Scores under every model; frequent sequences are kept in a table by hash."""
        if self._keys is None:
            self._keys = np.zeros(1 << _CACHE_BITS, dtype=np.uint64)
            self._scores = np.zeros((1 << _CACHE_BITS, len(self.langs)), dtype=np.float32)
        slot = (grams * _MULTIPLIER >> np.uint64(64 - _CACHE_BITS)).astype(np.int64)
        out = self._scores[slot]
        missing = np.flatnonzero(self._keys[slot] != grams)
        if len(missing):
            new, at = np.unique(grams[missing], return_inverse=True)
            scores = np.stack([m.log_p(new) for m in self.models], axis=1).astype(np.float32)
            out[missing] = scores[at]
            where = slot[missing]
            self._keys[where], self._scores[where] = grams[missing], scores[at]
        return out

    def predict(self, texts: Texts):
        """Language, score, cross-entropy and rejection of every text."""
        grams, sizes = sequences(texts)
        n = len(texts)
        lang, score = [UNKNOWN] * n, np.zeros(n)
        entropy, rejected = np.full(n, np.nan), np.ones(n, dtype=bool)
        rows = np.flatnonzero(sizes)
        if not len(rows) or not self.langs:
            return lang, score, entropy, rejected
        starts = np.cumsum(sizes[rows]) - sizes[rows]
        costs = -np.add.reduceat(self._log_p(grams), starts, axis=0, dtype=np.float64)
        costs /= sizes[rows][:, None]
        best = costs.argmin(axis=1)
        least = costs[np.arange(len(rows)), best]
        sharp = np.minimum(sizes[rows], 20)[:, None]
        score[rows] = 1 / np.exp(-(costs - least[:, None]) * sharp).sum(axis=1)
        entropy[rows] = least
        rejected[rows] = least > self.limits[best] + 4 * self.spreads[best] / np.sqrt(sizes[rows])
        for row, choice in zip(rows, best, strict=True):
            lang[row] = self.langs[choice]
        return lang, score, entropy, rejected


def held_out(key: str) -> Column:
    """Whether a row's id leaves no remainder: such rows are never learned from."""
    rest = F.pmod(F.crc32(column(key).cast("string").cast("binary")), F.lit(5))
    return F.coalesce(rest == 0, F.lit(False))


def _frequent(counts: DataFrame, most: int) -> DataFrame:
    """The most frequent sequences of each language, at most ``most`` of them."""
    spread = counts.groupBy("lang", "n").agg(F.count("*").alias("grams"))
    above = Window.partitionBy("lang").orderBy(F.col("n").desc())
    cuts = (
        spread.withColumn("kept", F.sum("grams").over(above))
        .groupBy("lang")
        .agg(F.coalesce(F.min(F.when(F.col("kept") <= most, F.col("n"))), F.max("n")).alias("least"))
    )
    return counts.join(written(cuts, "cuts"), "lang").where("n >= least").select("lang", "gram", "n")


def learn(
    docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", most_grams: int | None = None
) -> Identifier:
    """Models from all labelled rows that are not held out.

    Counts cover every such row, and a model keeps every sequence of its language, about
    forty bytes each.  With ``most_grams`` it keeps at most so many, those with at
    least the count at which that many are left.  A row without label or id teaches
    nothing.
    """
    taught = docs.where(column(lang).isNotNull() & column(key).isNotNull() & ~held_out(key))
    counts = written(count_sequences(taught, text, lang), "grams")
    kept = counts if most_grams is None else _frequent(counts, most_grams)
    by_lang: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    for row in counts.select("lang").distinct().collect():
        found = kept.where(F.col("lang") == row.lang).select("gram", "n").toArrow()
        by_lang[row.lang] = (
            found.column("gram").to_numpy().view(np.uint64), found.column("n").to_numpy().astype(np.float64)
        )
    return Identifier.fit(by_lang)


RESULTS = T.StructType(
    [
        T.StructField("lang_pred", T.StringType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("cross_entropy", T.DoubleType()),
        T.StructField("rejected", T.BooleanType()),
    ]
)


def identify(
    docs: DataFrame, model: Identifier, text: str = "text", keep: list[str] | None = None
) -> DataFrame:
    """``docs`` with ``lang_pred``, ``score``, ``cross_entropy`` and ``rejected``.

    Null texts and texts without letters are ``und`` with score 0 and are rejected;
    so is every text if nothing was learned.  Equal entropies go to the first
    language by name.  Only the text is looked at.  Columns of the input with a
    result's name are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def factory():
        return shared.value.predict

    return map_texts(docs, text, docs.columns if keep is None else keep, RESULTS, factory, piece_bytes=_PIECE_BYTES)


def keep_identified(
    docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang"
) -> DataFrame:
    """``docs`` without the rows that the models of their own labels reject."""
    model = docs.sparkSession.sparkContext.broadcast(learn(docs, key, text, lang))

    def factory():
        def work(texts: Texts):
            return [~model.value.predict(texts)[3]]

        return work

    none = T.StructType([])
    return map_texts(docs, text, docs.columns, none, factory, select=True, piece_bytes=_PIECE_BYTES)
