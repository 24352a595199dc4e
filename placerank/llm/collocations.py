"""Phrases that hold together, found by counting word sequences in hash tries.

Texts are cut into words once and stored as word ids.  Every task counts the sequences of
its part in a trie of word ids whose leaves are hash containers: a container that grows too
large bursts into one container for each next word.  When the tries of a task, one for each
language, hold too much together, their largest subtrees leave them as sorted runs.  Runs
are dealt out by the leading words of their phrases and merged there.

A phrase is no more frequent than any part of it, and most sequences of a corpus are rare.
So hashes of words are counted first, then those of pairs of frequent words, then those of
longer sequences in which every pair is frequent, and only sequences with a frequent hash
enter a trie.  What is
frequent is told to the tasks by filters of fixed size, which let some others pass and never
hold one back; counts are exact and the least count is applied to those.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from placerank.llm.common import batch_bytes, batch_iterator, column, small_batches
from placerank.sources.scratch import shuffles_dropped, written

LONGEST = 4
#: Entries of a container that bursts, words and entries in all tries of a task that spill
#: (about 100 bytes each), and entries of a run of hashes.
BURST = 1 << 12
SPILL = 1 << 19
HASHES = 1 << 21
#: Containers at the root of a trie, before words get their own.
RANGES = 1 << 10
#: Sequences a task gathers, in all languages, before they enter its tries.
GATHERED_ROWS = 1 << 19
#: A filter has this many bits (8 MB), whatever the corpus holds.
FILTER_BITS = 26
_CHUNK = 1 << 14
_MERGE_PARTS = 64
#: Phrases of a prefix partition, about.
PART_PHRASES = 20_000
#: Rows that leave a task at a time.
_ROWS = 1 << 16
#: Bytes of a batch that a task hands to its Python worker.
BATCH_BYTES = 4 << 20
#: Bytes of text of one language, and of all, that a task gathers before it cuts them.
PIECE = 1 << 19
_GATHERED = 16 << 20

_BREAK = b"\x0a"
_CUTS = b".,;:!?\x0a\x0b\x0c\x0d"
_UPPER = bytes(range(0x41, 0x5B))
#: A-Z to a-z, tabs to blanks, and all that ends a piece to one line feed.
_PLAIN = bytes.maketrans(_UPPER + _CUTS + b"\x09", _UPPER.lower() + _BREAK * len(_CUTS) + b"\x20")


# --- texts as word ids --------------------------------------------------------------
def word_ids(texts: Sequence[bytes]) -> tuple[list[bytes], np.ndarray]:
    """The distinct words of ``texts`` and the texts as ids of these; 0 ends a piece.

    Ids have two bytes if that suffices, else four.
    """
    ids: dict[bytes, int] = {_BREAK: 0, b"": -1}
    names, out = [_BREAK], []
    known = ids.get
    for word in _BREAK.join(texts).translate(_PLAIN).replace(_BREAK, b" \x0a ").split(b" "):
        at = known(word)
        if at is None:
            at = ids[word] = len(names)
            names.append(word)
        out.append(at)
    found = np.array(out, dtype=np.int32)
    return names, found[found >= 0].astype("<u2" if len(names) <= 1 << 16 else "<u4")


def _ids(raw: bytes, words: int) -> np.ndarray:
    return np.frombuffer(raw, "<u2" if words <= 1 << 16 else "<u4")


def _tokens(texts: DataFrame) -> DataFrame:
    """Rows of ``lang``, ``words`` and ``ids``: many short texts together, or one long one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[bytes]] = {}
        sizes: dict[str, int] = {}

        def cut(lang: str) -> pa.RecordBatch:
            names, ids = word_ids(held.pop(lang))
            sizes.pop(lang)
            columns = [
                pa.array([lang], pa.string()), pa.array([names], pa.list_(pa.binary())),
                pa.array([ids.tobytes()], pa.binary()),
            ]
            return pa.RecordBatch.from_arrays(columns, names=["lang", "words", "ids"])

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                held.setdefault(lang, []).append(text.as_py())
                sizes[lang] = sizes.get(lang, 0) + len(held[lang][-1])
                if sizes[lang] >= PIECE:
                    yield cut(lang)
                elif len(sizes) > 1 and sum(sizes.values()) >= _GATHERED:
                    yield cut(max(sizes, key=sizes.get))
        while held:
            yield cut(next(iter(held)))

    return small_batches(texts).mapInArrow(run, "lang string, words array<binary>, ids binary")


class Piece:
    """Word ids of a row of tokens, and hashes of its sequences."""

    def __init__(self, lang: str, words: list[bytes], ids: bytes):
        self.lang, self.words = lang, words
        self.ids = _ids(ids, len(words)).astype(np.int64)
        seed = xxhash.xxh64_intdigest(lang.encode())
        hashes = np.array([xxhash.xxh64_intdigest(w, seed) for w in words], dtype=np.uint64)
        self.hashes = hashes[self.ids]

    def sequences(
        self, longest: int, filters: Sequence[np.ndarray | None] = ()
    ) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Length, starts and hashes of the sequences of 1, 2, ... words that are in one piece.

        ``filters`` are for these lengths; sequences with a part that does not pass are left out.
        """
        starts = np.flatnonzero(self.ids)
        hashes = self.hashes[starts]
        follows = None
        for size in range(1, longest + 1):
            if size > 1:
                last = np.minimum(starts + size - 1, len(self.ids) - 1)
                inside = (self.ids[last] > 0) & (last == starts + size - 1)
                if follows is not None:
                    # All parts but the last pair have passed with the prefix.
                    inside &= follows[last - 1]
                starts, hashes, last = starts[inside], hashes[inside], last[inside]
                hashes = _joined(hashes, self.hashes[last])
            if size <= len(filters) and filters[size - 1] is not None:
                passing = _passes(filters[size - 1], hashes)
                starts, hashes = starts[passing], hashes[passing]
                if size == 2:
                    follows = np.zeros(len(self.ids), dtype=bool)
                    follows[starts] = True
            yield size, starts, hashes


def _joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The hash of a sequence from that of all its words but the last, and of the last."""
    mixed = left * np.uint64(0x9E3779B97F4A7C15) + right
    mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return mixed ^ (mixed >> np.uint64(32))


def _piece_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[Piece]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield Piece(*(c[i].as_py() for c in batch.columns))


# --- the trie -----------------------------------------------------------------------
_SLOTS = struct.Struct(f">{LONGEST}I").unpack


def _packed(ids: Sequence[int]) -> int:
    """Word ids as one number, 32 bits for each, the first highest; an id stands there plus 1.

    Such a number takes a third of the memory of a tuple.
    """
    code = 0
    for i in ids:
        code = code << 32 | i + 1
    return code


def _unpacked(code: int) -> tuple[int, ...]:
    return tuple([i - 1 for i in _SLOTS(code.to_bytes(4 * LONGEST)) if i])


def _coded(sequences: np.ndarray) -> list[int]:
    """Rows of word ids, packed."""
    code = [0] * len(sequences)
    for at in range(0, sequences.shape[1], 2):
        part = sequences[:, at : at + 2].astype(np.int64) + 1
        bits = 32 * part.shape[1]
        number = (part[:, 0] << 32 | part[:, 1] if bits == 64 else part[:, 0]).tolist()
        code = [a << bits | b for a, b in zip(code, number)] if at else number
    return code


def _cut(code: int) -> tuple[int, int]:
    """The first word of a packed sequence, and the others, packed."""
    shift = code.bit_length() - 1 & -32
    return (code >> shift) - 1, code & (1 << shift) - 1


class HatTrie:
    """Counts of sequences of word ids: hash containers under a shallow trie.

    A container is a dictionary from the rest of a sequence, packed, to its count.  A node is
    a list: the count of the sequence that ends there, and a dictionary of children by word
    id.  Most words begin few sequences, so those of one range of ids share a container of the
    root, at ``~`` of the range, until it bursts into one for each word.
    """

    def __init__(self, burst: int = BURST):
        self.burst = burst
        self.root: list = [0, {}]
        self.size = 0

    def add(self, sequence: tuple[int, ...], n: int) -> None:
        """``sequence`` of one word or more, ``n`` times."""
        self.put(sequence[0], _packed(sequence), n)

    def put(self, head: int, code: int, n: int) -> None:
        """The packed sequence ``code`` that begins with ``head``, ``n`` times."""
        node, depth = self.root, 0
        key = head if head in node[1] else ~(head % RANGES)
        if key == head:
            code, depth = _cut(code)[1], 1
        while type(child := node[1].get(key)) is list:
            if not code:
                self.size += not child[0]
                child[0] += n
                return
            node, depth = child, depth + 1
            key, code = _cut(code)
        if child is None:
            child = node[1][key] = {}
        if known := child.get(code):
            child[code] = known + n
            return
        child[code] = n
        self.size += 1
        if len(child) > self.burst and depth + 1 < LONGEST:
            found = self._burst(child)
            if depth:
                node[1][key] = found
            else:
                del node[1][key]
                node[1].update(found[1])

    @staticmethod
    def _burst(container: dict) -> list:
        node: list = [container.pop(0, 0), {}]
        for code, n in container.items():
            key, rest = _cut(code)
            node[1].setdefault(key, {})[rest] = n
        return node

    def _walk(self, at, prefix: tuple) -> Iterator[tuple[tuple, dict]]:
        if type(at) is list:
            if at[0]:
                yield prefix, {0: at[0]}
            for key, child in at[1].items():
                yield from self._walk(child, (*prefix, key))
        else:
            yield prefix, at

    def _entries(self, at) -> int:
        if type(at) is list:
            return bool(at[0]) + sum(map(self._entries, at[1].values()))
        return len(at)

    def spill_containers(self, keep: int) -> Iterator[tuple[tuple, dict]]:
        """Whole subtrees, the largest first, until at most ``keep`` entries stay.

        They come as containers, each with the words above it.
        """
        sizes = {top: self._entries(child) for top, child in self.root[1].items()}
        for top in sorted(sizes, key=sizes.get, reverse=True):
            if self.size <= keep:
                return
            self.size -= sizes[top]
            yield from self._walk(self.root[1].pop(top), (top,) if top >= 0 else ())

    def spill(self, keep: int) -> Iterator[tuple[tuple, int]]:
        """Sequences and counts of what ``spill_containers`` gives."""
        for prefix, container in self.spill_containers(keep):
            for code, n in container.items():
                yield prefix + _unpacked(code), n


# --- hashes that may be frequent ------------------------------------------------------
def _filter_places(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - FILTER_BITS)).astype(np.int64)


def _passes(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    places = _filter_places(hashes)
    return (bits[places >> 3] >> (7 - (places & 7)).astype(np.uint8)) & 1 == 1


def _added(runs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """One sorted run of distinct hashes and counts from several, which are let go of."""
    hashes, counts = (np.concatenate(part) for part in zip(*runs))
    runs.clear()
    order = np.argsort(hashes)
    hashes, counts = hashes[order], counts[order]
    starts = np.flatnonzero(np.r_[True, hashes[1:] != hashes[:-1]][: len(hashes)])
    return hashes[starts], np.add.reduceat(counts, starts) if len(starts) else counts


def _frequent_hashes(tokens: DataFrame, lengths: Sequence[int], filters: Sequence, least: int) -> DataFrame:
    """``words`` and ``hash`` of the sequences of these ``lengths`` found ``least`` times or more.

    Length 0 stands for the words of pairs that pass the filters, whatever their number.
    """

    def out(size: int, hashes: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        for start in range(0, len(hashes), _ROWS):
            some = slice(start, start + _ROWS)
            columns = [hashes[some].view(np.int64), counts[some]]
            words = pa.array(np.full(len(columns[0]), size, np.int8))
            yield pa.RecordBatch.from_arrays([words, *map(pa.array, columns)], names=["words", "hash", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = [f.value for f in filters]
        runs: dict[int, list] = {size: [] for size in lengths}
        longest = max(size or 2 for size in lengths)
        for piece in _piece_rows(batches):
            for size, starts, hashes in piece.sequences(longest, bits):
                if size == 2 and 0 in runs:
                    runs[0].append(np.unique(piece.hashes[np.r_[starts, starts + 1]], return_counts=True))
                if size in runs:
                    runs[size].append(np.unique(hashes, return_counts=True))
            for size in lengths:
                if sum(len(h) for h, _ in runs[size]) > HASHES:
                    runs[size] = [_added(runs[size])]
                    if len(runs[size][0][0]) > HASHES // 2:
                        yield from out(size, *runs[size].pop())
        for size, some in runs.items():
            if some:
                yield from out(size, *_added(some))

    counted = tokens.mapInArrow(run, "words byte, hash long, n long")
    # Runs hold no hash twice, so they are dealt out as they are.
    return (
        counted.repartition("hash").groupBy("words", "hash").agg(F.sum("n").alias("n"))
        .where((F.col("n") >= least) | (F.col("words") == 0)).select("words", "hash")
    )


def _bit_filter(hashes: DataFrame):
    """A broadcast filter of ``2 ** FILTER_BITS`` bits with the places of ``hash``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(1 << FILTER_BITS, dtype=bool)
        for batch in batches:
            held[_filter_places(batch.column(0).to_numpy().view(np.uint64))] = True
        chunks = np.packbits(held).reshape(-1, _CHUNK)
        full = np.flatnonzero(chunks.any(axis=1))
        yield pa.RecordBatch.from_arrays(
            [pa.array(full, pa.int32()), pa.array([chunks[k].tobytes() for k in full], pa.binary())],
            names=["chunk", "bits"],
        )

    def either(found: pa.Table) -> pa.Table:
        total = np.zeros(_CHUNK, dtype=np.uint8)
        for raw in found.column("bits"):
            total |= np.frombuffer(raw.as_py(), dtype=np.uint8)
        bits = pa.array([total.tobytes()], pa.binary())
        return pa.table({"chunk": found.column("chunk").slice(0, 1), "bits": bits})

    schema = "chunk int, bits binary"
    found = hashes.select("hash").mapInArrow(run, schema).groupBy("chunk").applyInArrow(either, schema)
    bits = np.zeros(((1 << FILTER_BITS) // 8 // _CHUNK, _CHUNK), dtype=np.uint8)
    for row in found.toLocalIterator():
        bits[row["chunk"]] = np.frombuffer(bytes(row["bits"]), dtype=np.uint8)
    return hashes.sparkSession.sparkContext.broadcast(bits.reshape(-1))


# --- counting -------------------------------------------------------------------------
def _distinct(sequences: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct sequences and their counts."""
    order = np.argsort(hashes)
    found = sequences[order]
    # Equal sequences have equal hashes and so stand together.  Unlike ones may too, which
    # only cuts their counts into several.
    fresh = np.ones(len(found), dtype=bool)
    fresh[1:] = (found[1:] != found[:-1]).any(axis=1)
    at = np.flatnonzero(fresh)
    return found[at], np.diff(np.r_[at, len(found)])


class Counter:
    """Sequences of one task's texts of one language.

    They are gathered up to a bounded number, so that a trie is asked once for all equal ones.
    """

    def __init__(self, burst: int = BURST):
        self.burst = burst
        self.renew()

    def renew(self) -> None:
        self.ids: dict[bytes, int] = {}
        self.names: list[bytes] = []
        self.trie = HatTrie(self.burst)
        self.held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        self.rows = 0

    def add(self, piece: Piece, longest: int, filters: Sequence) -> None:
        place = np.full(len(piece.words), -1, dtype=np.int32)
        for size, starts, hashes in piece.sequences(longest, filters):
            local = piece.ids[starts[:, None] + np.arange(size)]
            if size == 1:
                for at in np.unique(local).tolist():
                    word = piece.words[at]
                    place[at] = self.ids.setdefault(word, len(self.names))
                    if place[at] == len(self.names):
                        self.names.append(word)
            self.held.setdefault(size, []).append((place[local], hashes))
            self.rows += len(local)
        if self.rows > GATHERED_ROWS:
            self.settle()

    def settle(self) -> None:
        """What is gathered goes into the trie."""
        put = self.trie.put
        while self.held:
            _, parts = self.held.popitem()
            sequences, counts = _distinct(*(np.concatenate(p) for p in zip(*parts)))
            for start in range(0, len(counts), _CHUNK):
                some = slice(start, start + _CHUNK)
                heads = sequences[some, 0].tolist()
                for head, code, n in zip(heads, _coded(sequences[some]), counts[some].tolist()):
                    put(head, code, n)
        self.rows = 0

    def size(self) -> int:
        """Words and entries it holds, without what is gathered."""
        return len(self.names) + self.trie.size

    def run(self, keep: int = 0) -> list[tuple[bytes, int]]:
        """Phrases and counts: what has to leave so that ``keep`` entries stay."""
        self.settle()
        names, found = [b"", *self.names], []
        for prefix, container in self.trie.spill_containers(keep):
            before = b" ".join([self.names[i] for i in prefix])
            if ends := container.pop(0, 0):
                found.append((before, ends))
            before += b" " if prefix else b""
            found += [
                (before + b" ".join([names[i] for i in _SLOTS(code.to_bytes(4 * LONGEST)) if i]), n)
                for code, n in container.items()
            ]
        return found

    def overflow(self, most: int | None = None) -> list[tuple[bytes, int]]:
        """A run of half of the entries if it holds more than ``most`` (``SPILL``).

        All leave if its words, which stay until then, would be most of what it holds.
        """
        if self.size() <= (SPILL if most is None else most):
            return []
        self.settle()
        if len(self.names) <= self.trie.size // 2:
            return self.run(self.trie.size // 2)
        found = self.run()
        self.renew()
        return found


def _prefix(phrase: bytes) -> bytes:
    """A phrase of one or two words itself, all words but the last of a longer one."""
    return phrase[: phrase.rfind(b" ")] if phrase.count(b" ") > 1 else phrase


def _runs(tokens: DataFrame, longest: int, filters: Sequence, parts: int) -> DataFrame:
    """Sorted runs of phrases with their counts in a piece of a task, cut in prefix partitions.

    A row is what a run has of one of ``parts`` partitions: phrases, none of which has a line
    feed, with line feeds between them, and counts of eight bytes.
    """

    def rows(lang: str, found: list) -> Iterator[pa.RecordBatch]:
        runs: dict[int, list] = {}
        for entry in found:
            runs.setdefault(xxhash.xxh64_intdigest(_prefix(entry[0])) % parts, []).append(entry)
        for part, run in runs.items():
            phrases, counts = zip(*sorted(run))
            columns = [
                pa.array([lang], pa.string()), pa.array([part], pa.int64()),
                pa.array([_BREAK.join(phrases)], pa.binary()),
                pa.array([np.array(counts, dtype="<i8").tobytes()], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "part", "phrases", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = [f.value for f in filters]
        counters: dict[str, Counter] = {}
        for piece in _piece_rows(batches):
            counters.setdefault(piece.lang, Counter()).add(piece, longest, bits)
            # What a task holds is bounded in all languages together, however many there are.
            if sum(c.rows for c in counters.values()) > GATHERED_ROWS:
                for counter in counters.values():
                    counter.settle()
            if sum(c.size() for c in counters.values()) > SPILL:
                for lang, counter in counters.items():
                    yield from rows(lang, counter.overflow(0))
                counters = {lang: c for lang, c in counters.items() if c.size()}
        for lang, counter in counters.items():
            yield from rows(lang, counter.run())

    return tokens.mapInArrow(run, "lang string, part long, phrases binary, counts binary")


def _merged(runs: DataFrame, least: int) -> DataFrame:
    """Runs of each prefix partition added up; phrases found ``least`` times or more stay.

    Few phrases share all words but the last, so no partition is much larger than others.
    Runs stream by: a partition holds one number for each of its phrases.
    """

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[bytes, int] = {}
        lang = None
        for batch in batches:
            lang = batch.column(0)[0].as_py()
            for phrases, counts in zip(batch.column(2), batch.column(3)):
                numbers = np.frombuffer(counts.as_py(), dtype="<i8").tolist()
                for phrase, n in zip(phrases.as_py().split(_BREAK), numbers):
                    total[phrase] = total.get(phrase, 0) + n
        found = sorted((phrase, n) for phrase, n in total.items() if n >= least)
        columns = [
            pa.array([lang] * len(found), pa.string()),
            pa.array([p for p, _ in found], pa.binary()).cast(pa.string()),
            pa.array([p.count(b" ") + 1 for p, _ in found], pa.int32()),
            pa.array([n for _, n in found], pa.int64()),
        ]
        yield pa.RecordBatch.from_arrays(columns, names=["lang", "phrase", "words", "n"])

    schema = "lang string, phrase string, words int, n long"
    return runs.groupBy("lang", "part").applyInArrow(batch_iterator(merge), schema)


def _word_totals(tokens: DataFrame) -> DataFrame:
    """``n``, all occurrences of all words, by ``lang``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, raw = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            counts = [np.count_nonzero(_ids(i, n)) for i, n in zip(raw, sizes)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64())], names=["lang", "n"]
            )

    found = tokens.select("lang", F.size("words"), "ids").mapInArrow(run, "lang string, n long")
    return found.groupBy("lang").agg(F.sum("n").alias("n"))


def count_phrases(
    df: DataFrame, text: str = "text", lang: str = "lang", least: int = 30, longest: int = LONGEST
) -> tuple[DataFrame, DataFrame]:
    """Phrases found ``least`` times or more, and words by language.

    Phrases have 2 to ``longest`` words; the words of such phrases are there too.  The first is ``lang``, ``phrase`` (words joined by blanks), ``words`` and ``n``; the
    second ``lang`` and ``n``, all occurrences of all words.  Both are written tables.
    """
    if not 2 <= longest <= LONGEST:
        raise ValueError(f"phrases have 2 to {LONGEST} words")
    texts = df.where(column(text).isNotNull()).select(
        F.coalesce(column(lang).cast("string"), F.lit("und")).alias("lang"),
        column(text).cast("binary").alias("text"),
    )
    spark = df.sparkSession

    def kept(found: DataFrame, label: str) -> DataFrame:
        with shuffles_dropped(spark), batch_bytes(spark, BATCH_BYTES):
            return written(found, label)

    tokens = kept(_tokens(texts), "tokens")
    totals = kept(_word_totals(tokens), "totals")

    passing: list[int] = []

    def filters_of(lengths: Sequence[int], filters: Sequence) -> list:
        hashes = kept(_frequent_hashes(tokens, lengths, filters, least), "hashes")
        passing.append(hashes.count())
        return [_bit_filter(hashes.where(F.col("words") == size)) for size in lengths]

    filters = filters_of([1], [])
    filters += filters_of([2], filters)
    # Words that no frequent pair has are part of no phrase.
    filters[0], *longer = filters_of([0, *range(3, longest + 1)], filters)
    filters += longer
    parts = -(-sum(passing) // PART_PHRASES) or 1
    runs = _runs(tokens, longest, filters, parts)
    return kept(_merged(runs, least), "phrases"), totals


# --- scores ---------------------------------------------------------------------------
def _part(first: Column | int, length: Column) -> Column:
    return F.array_join(F.slice("parts", first, length), " ")


def _scored(phrases: DataFrame) -> DataFrame:
    """Candidates with the cut of the lowest score: ``l``, ``r`` and ``score``."""
    split = phrases.where("words > 1").withColumn("parts", F.split("phrase", " "))
    cuts = split.select(
        "lang", "phrase", "words", F.col("n").alias("a"), "parts",
        F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"),
    ).select(
        "lang", "phrase", "words", "a", "k",
        _part(1, F.col("k")).alias("first"), _part(F.col("k") + 1, F.col("words")).alias("last"),
    )
    known = phrases.select("lang", F.col("phrase").alias("at"), "n")
    left = known.select("lang", F.col("at").alias("first"), F.col("n").alias("l"))
    right = known.select("lang", F.col("at").alias("last"), F.col("n").alias("r"))
    score = F.expr("(2000000 * cast(a as decimal(19,0))) div (cast(l as decimal(19,0)) + r)")
    best = F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut")
    return (
        cuts.join(left, ["lang", "first"])
        .join(right, ["lang", "last"])
        .groupBy("lang", "phrase", "words", "a")
        .agg(best)
        .select("lang", "phrase", "words", "a", "cut.l", "cut.r", "cut.score")
    )


def _contained(phrases: DataFrame, longest: int) -> DataFrame:
    """The largest count among the longer phrases that a phrase of two words or more lies in."""
    split = phrases.where("words > 2").withColumn("parts", F.split("phrase", " "))

    def inside(size: int) -> DataFrame:
        starts = F.sequence(F.lit(1), F.col("words") - size + 1)
        parts = F.transform(starts, lambda i: _part(i, F.lit(size)))
        return split.where(F.col("words") > size).select("lang", "n", F.explode(parts).alias("phrase"))

    inner = [inside(size) for size in range(2, longest)]
    every = inner[0]
    for part in inner[1:]:
        every = every.unionByName(part)
    return every.groupBy("lang", "phrase").agg(F.max("n").alias("around"))


def collocations(
    df: DataFrame,
    text: str = "text",
    lang: str = "lang",
    least: int = 30,
    longest: int = LONGEST,
    most: int = 2000,
    share: int = 80,
) -> DataFrame:
    """The ``most`` best phrases of each language, by how much their parts keep together.

    ``lang`` (null: ``und``), ``rank`` from 1, ``phrase``, its count ``a``, the counts ``l``
    and ``r`` of the parts at its weakest cut, ``n`` (all words of the language) and ``score``,
    2,000,000 times ``a`` over ``l + r``, rounded down.  Texts are lower-cased in A-Z and cut in
    pieces at ``.,;:!?`` and line ends; phrases do not cross pieces.  A phrase inside a longer
    one that has ``share`` percent of its occurrences or more is left out.  Null and empty
    texts have no words; repeated rows count again; an empty table gives no rows; a phrase of
    equal score and count comes in byte order.  Other columns are not read.
    """
    phrases, totals = count_phrases(df, text, lang, least, longest)
    found = _scored(phrases)
    if longest > 2:
        found = found.join(_contained(phrases, longest), ["lang", "phrase"], "left").where(
            F.col("around").isNull()
            | (F.col("around") * F.lit(100).cast("decimal(5,0)") < F.col("a") * F.lit(share).cast("decimal(5,0)"))
        )
    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(_MERGE_PARTS))
    some = Window.partitionBy("lang", part).orderBy(*order)
    every = Window.partitionBy("lang").orderBy(*order)
    # The best of hashed parts first, so that no task sorts all phrases of a language.
    best = found.withColumn("rank", F.row_number().over(some)).where(F.col("rank") <= most)
    ranked = best.withColumn("rank", F.row_number().over(every)).where(F.col("rank") <= most)
    return ranked.join(totals, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"
    )
