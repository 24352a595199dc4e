"""Components against all pairs compared by brute force."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from placerank.llm import jaccard_join as j
from placerank.llm.graph import components
from placerank.sources.scratch import shuffles_dropped, written


def brute_components(rows: list[tuple]) -> dict:
    sets = []
    for _, text in rows:
        words = (text or "").lower().split(" ")
        words = [w for w in words if w]
        grams = {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)}
        sets.append(grams if words else set())
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for k in range(i):
            b = sets[k]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                parent[root(i)] = root(k)
    smallest: dict = {}
    for i, (key, _) in enumerate(rows):
        smallest.setdefault(root(i), []).append(key)
    return {
        (key, rows[i][1]): min((x for x in smallest[root(i)] if x is not None), default=None)
        for i, (key, _) in enumerate(rows)
    }


def near_copies(seed: int) -> list[tuple]:
    """Groups around common texts, chains, shared passages and unrelated texts."""
    r = random.Random(seed)

    def prose(n):
        return [f"w{r.randrange(300)}" for _ in range(n)]

    rows, passage = [], prose(40)
    for _ in range(5):
        base = prose(r.randrange(20, 120))
        for _ in range(r.randrange(2, 25)):
            copy = list(base)
            for _ in range(r.randrange(4)):
                copy[r.randrange(len(copy))] = f"x{r.randrange(10**6)}"
            rows.append(" ".join(copy))
    for _ in range(40):
        rows.append(" ".join(passage + prose(r.randrange(1, 16))))
    rows += [" ".join(prose(r.randrange(1, 60))) for _ in range(40)]
    chain = prose(100)
    for i in range(0, 60, 3):
        rows.append(" ".join(chain[i:] + [f"c{k}" for k in range(i)]))
    rows += [rows[0]] * 3
    r.shuffle(rows)
    return [(i * 7 % 1009, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize("rounds, seed", [(0, 1), (0, 2), (2, 3)])
def test_components_equal_brute_force(spark, monkeypatch, rounds, seed):
    monkeypatch.setattr(j, "_STAR_ROUNDS", rounds)
    rows = near_copies(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    found = {r.doc_id: r.component_id for r in j.jaccard_components(docs).collect()}
    assert found == {key: c for (key, _), c in brute_components(rows).items()}


def test_prefixes_of_linked_sets_share_what_they_ask_for():
    r = np.random.default_rng(5)
    levels = r.integers(3, 12, 1 << j.SKETCH_BITS).astype(np.uint8)
    for _ in range(300):
        base = np.unique(r.integers(0, 2**64, r.integers(1, 120), dtype=np.uint64))
        keep = r.random(len(base)) > 0.08
        other = np.union1d(base[keep], r.integers(0, 2**64, r.integers(0, 6), dtype=np.uint64))
        shared = len(np.intersect1d(base, other))
        if 100 * shared < 80 * (len(base) + len(other) - shared):
            continue
        a, asked_a, _ = j.adaptive_prefix(base, levels, 5, 80)
        b, asked_b, _ = j.adaptive_prefix(other, levels, 5, 80)
        assert len(np.intersect1d(a, b)) >= min(asked_a, asked_b)


def test_odd_rows(spark):
    rows = [(3, None), (4, ""), (5, " \n\t"), (6, "short text"), (2, "Short TEXT"), (None, "SHORT text"),
            (7, "a b c d e f " * 20_000), (7, "a b c d e f " * 20_000), (None, "nobody has this one here")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, component_id int")
    found = [tuple(r) for r in j.jaccard_components(docs).collect()]
    assert sorted(found, key=str) == sorted(
        [(3, 0, 3), (4, 0, 4), (5, 0, 5), (6, 1, 2), (2, 1, 2), (None, 1, 2), (7, 6, 7), (7, 6, 7), (None, 1, None)],
        key=str)
    kept = j.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == [2, 3, 4, 5, 7, None, None]
    assert j.jaccard_components(docs.limit(0)).count() == 0


def test_components_of_hubs_and_paths(spark):
    edges = [(i, i + 1) for i in range(50)] + [(1000, k) for k in range(1001, 1200)] + [(7, 7), (1000, 1001)]
    found = components(spark.createDataFrame(edges, "u long, v long"))
    rows = {r.node: r.component for r in found.collect()}
    assert rows == {i: 0 for i in range(51)} | {i: 1000 for i in range(1000, 1200)}
    assert components(spark.createDataFrame([], "u long, v long")).where(F.col("node") > 0).count() == 0


def test_no_pair_is_measured_twice(spark, monkeypatch):
    measured = []

    def kept(df, label):
        df = written(df, label)
        if label == "pairs":
            measured.extend(tuple(sorted(r)) for r in df.select("u", "v").collect())
        return df

    monkeypatch.setattr(j, "written", kept)
    texts = [[f"t{t}w{k}" for k in range(120)] for t in range(20)]
    copies = [["x" if k % 30 == 15 else w for k, w in enumerate(t)] for t in texts]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts + copies)]
    j.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert measured and len(measured) == len(set(measured))


def test_lists_keep_documents_with_one_of_similar_size(spark):
    rows = [(1, 100, [7, 8]), (2, 79, [7, 9]), (3, 81, [9, 8]), (4, 300, [8, 10]), (5, 310, [11, 10])]
    prefixes = spark.createDataFrame(rows, "node long, n int, prefix array<long>")
    found = sorted(tuple(r) for r in j._lists(prefixes, 80).collect())
    assert found == [(1, 8, 1), (2, 9, 1), (3, 8, 1), (3, 9, 0), (4, 10, 1), (5, 10, 1)]


def test_shortened_prefixes_share_no_less():
    a, b = [1 << 32, (1 << 32) + 1, 5 << 32], [1 << 32, (1 << 32) + 1, -(7 << 32)]
    (short, other), lost = (x.to_pylist() for x in j._shortened(pa.array([a, b], pa.list_(pa.int64()))))
    assert lost == [1, 1] and short == [1, 1, 5] and other == [1, 1, -7]
    assert len({*short} & {*other}) + lost[0] >= len({*a} & {*b})


def test_shuffle_files_go_with_their_query(spark):
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(setting, "false")
    with pytest.raises(KeyError), shuffles_dropped(spark):
        assert spark.conf.get(setting) == "true"
        raise KeyError
    assert spark.conf.get(setting) == before


def test_workers_keep_small_tables():
    j._HASHES.clear()
    j.shingles(" ".join(f"w{k}" for k in range(100_000)).encode())
    assert len(j._HASHES) <= 1 << 15
    j._HASHES.clear()


def test_bits_of_a_filter_are_set_in_place():
    hashes = np.random.default_rng(5).integers(-(2**63), 2**63 - 1, 5000)
    hashes[:4] = [0, -1, 2**63 - 1, -(2**63)]
    bits = np.zeros((1 << j.FILTER_BITS) // 8, dtype=np.uint8)
    j._hold(bits, hashes[:3000])
    j._hold(bits, np.append(hashes[1000:], hashes[:10]))
    held = np.zeros(1 << j.FILTER_BITS, dtype=bool)
    held[j._filter_places(hashes)] = True
    assert (bits == np.packbits(held)).all() and j._may_hold(bits, hashes).all()
