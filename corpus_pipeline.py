"""A training corpus from documents, in five stages.

Each stage takes what the one before kept, as a table in the shared folder, and
returns the columns of documents; the last adds the shard and the place in it.
"""

from __future__ import annotations

from placerank.llm import decontamination, jaccard_join, language, mixing, sharding
from placerank.llm.common import table
from placerank.sources.scratch import written

SHARDS = 40


def language_id(spark, docs, sf_dir):
    """Documents whose language the models of their own labels recognise."""
    return language.keep_identified(docs)


def jaccard_groups(spark, docs, sf_dir):
    """One document of each group of near duplicates, that with the smallest id."""
    return jaccard_join.keep_one(docs)


def decontaminated(spark, docs, sf_dir):
    """Documents without any ten-word window of a benchmark item."""
    return decontamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark, docs, sf_dir):
    """Every document as often as the mix of sources takes it."""
    return mixing.repeat_copies(docs)


def sharded(spark, docs, sf_dir):
    """Documents with their shard and their place in it."""
    return sharding.assign_shards(docs, shards=SHARDS)


STAGES = [
    ("language_id", language_id),
    ("jaccard_join", jaccard_groups),
    ("decontamination", decontaminated),
    ("mixing", mixed),
    ("sharding", sharded),
]

#: SQL cannot express language models; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages over ``documents``; what a stage keeps is written and read by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
