"""Phrases against a plain count; the trie when it bursts and spills."""

import random
import re
import tracemalloc
from collections import Counter, defaultdict

from placerank.llm import collocations as c

SCHEMA = "doc_id long, text string, lang string, rank string, n string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, least, most, longest=4):
    counts, total = Counter(), Counter()
    for text, lang in rows:
        lang = lang or "und"
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            words = re.findall("[^\x20\x09]+", piece)
            total[lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    counts[lang, tuple(words[i : i + k])] += 1
    found = {key: a for key, a in counts.items() if a >= least and len(key[1]) > 1}
    around = Counter()
    for (lang, w), a in found.items():
        for size in range(2, len(w)):
            for i in range(len(w) - size + 1):
                around[lang, w[i : i + size]] = max(around[lang, w[i : i + size]], a)
    out = defaultdict(list)
    for (lang, w), a in found.items():
        if 100 * around[lang, w] >= 80 * a:
            continue
        cuts = [(counts[lang, w[:k]], counts[lang, w[k:]], k) for k in range(1, len(w))]
        score, _, left, right = min((2_000_000 * a // (x + y), k, x, y) for x, y, k in cuts)
        out[lang].append((-score, -a, " ".join(w).encode(), left, right))
    return sorted(
        (lang, i + 1, phrase.decode(), -a, left, right, total[lang], -score)
        for lang, some in out.items()
        for i, (score, a, phrase, left, right) in enumerate(sorted(some)[:most])
    )


def made(n=400, seed=3):
    pick = random.Random(seed)
    words = ["Ab", "c", "é", "日本", "d-d", " x", "STRASSE", "ß", "İ", "w\x00w"]
    ends = [" ", " ", "  ", "\t", ". ", ", ", "\n", "\x0b", "!?", "\x0d\x0a", "-", " : "]
    rows = []
    for _ in range(n):
        text = "".join(pick.choice(words) + pick.choice(ends) for _ in range(pick.randint(0, 60)))
        rows.append((text, pick.choice(["en", "en", "en", "de", None, "und"])))
    return rows + [(None, "en"), ("", None), ("one two " * 300, "fr"), (" \t ", "xx")]


def ours(spark, rows, **options):
    df = spark.createDataFrame([(i, *row, "r", "n") for i, row in enumerate(rows)], SCHEMA).repartition(3)
    return sorted(tuple(r) for r in c.collocations(df, **options).collect())


def test_equals_plain_count(spark):
    rows = made()
    assert ours(spark, rows, least=5) == plain(rows, 5, 2000)
    assert ours(spark, rows, least=3, most=7) == plain(rows, 3, 7)
    assert ours(spark, rows, least=4, longest=2) == plain(rows, 4, 2000, longest=2)


def test_when_tries_burst_and_spill(monkeypatch):
    rows = made(300, 4)
    monkeypatch.setattr(c, "SPILL", 40)
    monkeypatch.setattr(c, "GATHERED_ROWS", 50)
    whole, runs = Counter(), 0
    counter = c.Counter(burst=3)
    for text, _ in rows:
        words, ids = c.word_ids([(text or "").encode()])
        counter.add(c.Piece("en", words, ids.tobytes()), 4, [])
        left = counter.overflow()
        runs += bool(left)
        for phrase, n in left:
            whole[phrase.decode()] += n
    for phrase, n in counter.run():
        whole[phrase.decode()] += n
    expected = Counter()
    for text, _ in rows:
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            words = re.findall("[^\x20\x09]+", piece)
            for k in range(1, 5):
                expected.update(" ".join(words[i : i + k]) for i in range(len(words) - k + 1))
    assert runs > 1 and whole == expected


def test_filters_hold_no_frequent_sequence_back():
    words, ids = c.word_ids([b"a b c d. a b c d a b. b c"])
    piece = c.Piece("en", words, ids.tobytes())
    full = {size: hashes for size, _, hashes in piece.sequences(4)}
    assert [len(full[size]) for size in (1, 2, 3, 4)] == [12, 9, 6, 4]
    filters = []
    for size in (1, 2):  # those found twice or more
        bits = c.np.zeros(1 << c.FILTER_BITS, dtype=bool)
        found, counts = c.np.unique(full[size], return_counts=True)
        bits[c._filter_places(found[counts > 1])] = True
        filters.append(c.np.packbits(bits))
    kept = {size: starts for size, starts, _ in piece.sequences(4, filters)}
    assert len(kept[1]) == 12 and len(kept[2]) == 8  # all but "d a"
    assert len(kept[3]) == 4 and len(kept[4]) == 2


def test_small_pieces_and_runs(spark, monkeypatch):
    rows = made(200, 5)
    monkeypatch.setattr(c, "HASHES", 30)
    monkeypatch.setattr(c, "PIECE", 100)
    assert ours(spark, rows, least=5) == plain(rows, 5, 2000)


def test_trie_spills_whole_subtrees_in_order():
    trie = c.HatTrie(burst=2)
    for i in range(20):
        trie.add((1, i), 1)
        trie.add((1, i, 7), 2)
    trie.add((2, 5), 3)
    trie.add((1, 3), 1)
    assert trie.size == 41
    spilled = dict(trie.spill(5))
    assert trie.size == 1 and all(s[0] == 1 for s in spilled) and spilled[1, 3] == 2 and spilled[1, 3, 7] == 2
    assert dict(trie.spill(0)) == {(2, 5): 3} and trie.size == 0


def test_no_rows(spark):
    assert ours(spark, []) == [] and ours(spark, [(None, None), ("", "en")]) == []


def test_repeated_rows_count_again(spark):
    rows = [("a b", "en")] * 30
    assert ours(spark, rows) == [("en", 1, "a b", 30, 30, 30, 60, 1_000_000)]


def test_a_task_holds_no_more_in_many_languages(monkeypatch):
    monkeypatch.setattr(c, "SPILL", 400)
    monkeypatch.setattr(c, "GATHERED_ROWS", 100)
    live, most = [], 0

    class Watched(c.Counter):
        def __init__(self, *args):
            super().__init__(*args)
            live.append(self)

    class Frame:
        def mapInArrow(self, run, schema):
            return run

    monkeypatch.setattr(c, "Counter", Watched)
    run = c._runs(Frame(), 4, [], 3)
    pick = random.Random(7)
    texts = [(f"l{i % 8}", " ".join(f"w{pick.randrange(30)}" for _ in range(20))) for i in range(200)]

    def batches():
        nonlocal most
        for lang, text in texts:
            words, ids = c.word_ids([text.encode()])
            yield c.pa.RecordBatch.from_pydict({"lang": [lang], "words": [words], "ids": [ids.tobytes()]})
            most = max(most, sum(len(x.names) + x.trie.size + x.rows for x in live))

    counted = Counter()
    for batch in run(batches()):
        for row in batch.to_pylist():
            for phrase, n in zip(row["phrases"].split(b"\n"), c.np.frombuffer(row["counts"], "<i8").tolist()):
                counted[row["lang"], phrase.decode()] += n
    expected = Counter()
    for lang, text in texts:
        words = text.split()
        for k in range(1, 5):
            expected.update((lang, " ".join(words[i : i + k])) for i in range(len(words) - k + 1))
    assert counted == expected and most <= 400 + 100 + 2 * 4 * 20


def test_an_entry_takes_few_bytes():
    trie = c.HatTrie()
    tracemalloc.start()
    for word in range(20_000):
        for i in range(4):
            trie.add((word, 300 + i, 100_000 + word, 400 + i), 1)
    held, _ = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert trie.size == 80_000 and held < 150 * trie.size


def test_batches_and_shuffles_are_bounded_while_phrases_are_counted(spark, monkeypatch):
    names = ["spark.sql.execution.arrow.maxBytesPerBatch", "spark.sql.classic.shuffleDependency.fileCleanup.enabled"]
    before, seen = [spark.conf.get(n, None) for n in names], []
    write = c.written

    def watched(df, label):
        seen.append([spark.conf.get(n, None) for n in names])
        return write(df, label)

    monkeypatch.setattr(c, "written", watched)
    assert ours(spark, [("a b", "en")] * 30) == [("en", 1, "a b", 30, 30, 30, 60, 1_000_000)]
    assert len(seen) == 6 and all(int(size.rstrip("b")) == c.BATCH_BYTES and drop == "true" for size, drop in seen)
    after = [spark.conf.get(n, None) for n in names]
    assert after[0] == before[0] and after[1] in (before[1], "false")


def test_batches_are_cut_by_bytes(spark):
    rows = spark.createDataFrame([(i, "x" * 1000) for i in range(200)], "i long, text string").repartition(1)

    def sizes(batches):
        for batch in batches:
            yield c.pa.RecordBatch.from_pydict({"n": c.pa.array([batch.num_rows], c.pa.int64())})

    with c.batch_bytes(spark, 20_000):
        found = [r.n for r in rows.mapInArrow(sizes, "n long").collect()]
    assert sum(found) == 200 and max(found) < 40
