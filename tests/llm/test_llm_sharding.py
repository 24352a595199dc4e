"""Shards against the hash stepped one key at a time."""

import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from placerank.llm import sharding
from placerank.llm.queries import QUERIES


def jump_one(key: int, shards: int) -> int:
    landed, at = -1, 0
    while at < shards:
        landed = at
        key = (key * 2862933555777941757 + 1) % 2**64
        at = int((landed + 1) * ((1 << 31) / ((key >> 33) + 1)))
    return landed


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), min_size=1, max_size=50), st.integers(1, 2000))
def test_jump_hash(keys, shards):
    found = sharding.jump_hash(np.array(keys, dtype=np.uint64), shards)
    assert found.tolist() == [jump_one(k, shards) for k in keys]


def test_query(spark):
    folder = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = QUERIES["op9_shard_by_key"](spark, folder).collect()
    assert {r.doc_id for r in rows} == set(texts)
    by_shard: dict = {}
    for r in rows:
        raw = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law) == (len(raw) + 16, zlib.crc32(raw), "key")
        assert r.grown_shard in (r.shard, 40)
        by_shard.setdefault(r.shard, []).append(r.slot)
    assert set(by_shard) <= set(range(40))
    assert all(sorted(slots) == list(range(len(slots))) for slots in by_shard.values())
    assert max(map(len, by_shard.values())) < 50


def test_odd_rows(spark):
    rows = [(1, None, 9), (1, "", 9), (None, "é", 9), (2, "x" * 200_000, 9), (2, "x" * 200_000, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, Shard int")
    placed = sharding.assign_shards(docs, 7)
    assert placed.columns.count("shard") == 1 and "Shard" not in placed.columns
    found = placed.collect()
    assert sorted(r.size for r in found) == [16, 16, 18, 200_016, 200_016]
    assert [r.text_crc32 for r in found if r.size == 16] == [0, 0]
    twins = [r for r in found if r.doc_id == 2]
    assert len({r.shard for r in twins}) == 1 and len({r.slot for r in twins}) == 2
    assert sharding.assign_shards(docs.limit(0), 7).count() == 0
