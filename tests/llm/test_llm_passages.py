"""Planted passages are found and cut; texts without repeats are left alone."""

import random

import numpy as np

from placerank.llm import passages as p


def prose(r, n):
    return [f"{r.choice('bcdfgklmnprst')}{r.choice('aeiouéü')}{r.randrange(10**5)}"[: r.randrange(2, 8)] for _ in range(n)]


def test_chunks_cover_the_text_and_resist_shifts():
    r = random.Random(1)
    text = " ".join(prose(r, 800)).encode()
    data = np.frombuffer(text, np.uint8)
    ends = p.chunk_ends(data)
    assert ends[-1] == len(text) and (np.diff(ends, prepend=0) > 0).all() and 15 < len(text) / len(ends) < 45
    moved = np.frombuffer(text[:100] + b"inserted" + text[100:], np.uint8)
    shifted = set((p.chunk_ends(moved) - 8).tolist())
    assert len([e for e in ends if e > 150 and e not in shifted]) == 0
    assert p.chunk_ends(np.zeros(5000, np.uint8)).max() == 5000
    assert np.diff(p.chunk_ends(np.zeros(5000, np.uint8)), prepend=0).max() <= 1024


def planted(seed):
    r = random.Random(seed)
    shared = [prose(r, n) for n in (50, 51, 60, 75, 120)] + [prose(r, 49), prose(r, 30)]
    rows, truth = [], set()
    for i in range(120):
        words = prose(r, r.randrange(30, 200))
        if i % 3 == 0:
            which = (i // 3) % len(shared)
            at = r.randrange(len(words))
            words[at:at] = shared[which]
            if which < 5:
                truth.add((i, at, at + len(shared[which])))
        rows.append((i, " ".join(words)))
    return rows, truth


def test_planted_passages(spark):
    rows, truth = planted(4)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found = p.repeated_passages(docs).collect()
    spans = {r.doc_id: (r.start_word, r.end_word) for r in found}
    assert len(spans) == len(found) and spans.keys() == {i for i, _, _ in truth}
    for i, start, end in truth:
        assert start <= spans[i][0] <= start + 25 and end - 25 <= spans[i][1] <= end
    keepers = {r.doc_id for r in found if r.keeper}
    assert len(keepers) == 5
    cleaned = p.without_repeats(docs)
    assert cleaned.columns == docs.columns
    before = {i: len(t.split(" ")) for i, t in rows}
    after = {r.doc_id: len(r.text.split(" ")) for r in cleaned.collect()}
    cut = {i: e - s for i, (s, e) in spans.items() if i not in keepers}
    assert after == {i: n - cut.get(i, 0) for i, n in before.items()}


def test_odd_rows(spark):
    r = random.Random(9)
    passage = " ".join(prose(r, 80))
    rows = [(1, None), (2, ""), (None, passage), (3, passage), (4, f"x {passage} y {passage} z"),
            (5, " ".join(prose(r, 60_000))), (6, passage), (6, passage), (7, "aaaa " * 30_000)]
    docs = spark.createDataFrame([(*row, 1) for row in rows], "doc_id long, text string, n_words int")
    found = {(r.doc_id, r.keeper) for r in p.repeated_passages(docs).collect()}
    assert found == {(3, True), (4, False), (6, False)}
    assert p.repeated_passages(docs.limit(0)).count() == 0
    assert p.without_repeats(docs).count() == 9


def test_partner_beyond_the_neighbours_in_id_order(spark):
    r = random.Random(12)
    passage = prose(r, 60)
    rows = [(i, prose(r, 40) + passage + prose(r, 40)) for i in (10, 20)]
    rows += [(11 + k, prose(r, 40) + passage[5 * k : 5 * k + 20] + prose(r, 40)) for k in range(9)]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")
    found = sorted((x.doc_id, x.start_word, x.end_word, x.other_doc_id, x.keeper) for x in p.repeated_passages(docs).collect())
    assert found == [(10, 40, 100, 20, True), (20, 40, 100, 10, False)]


def test_passages_of_any_chunks_by_brute_force(spark):
    r = random.Random(21)
    few = prose(r, 3)
    shared = [prose(r, n) for n in (50, 55, 90)] + [[r.choice(few) for _ in range(70)], ["a"] * 50]
    rows = []
    for i in range(60):
        words = prose(r, r.randrange(20, 90))
        for part in r.sample(shared, r.randrange(3)):
            at = r.randrange(len(words))
            words[at:at] = part[: r.choice((49, 50, len(part)))]
        rows.append((i, words))
    holders = {}
    for i, words in rows:
        for k in range(len(words) - 49):
            holders.setdefault(tuple(words[k : k + 50]), set()).add(i)
    truth = {(i, k + j) for i, words in rows for k in range(len(words) - 49)
             if len(holders[tuple(words[k : k + 50])]) > 1 for j in range(50)}
    docs = spark.createDataFrame([(i, r.choice((" ", "\n", "  ")).join(w)) for i, w in rows], "doc_id long, text string")
    found = p.repeated_passages(docs).collect()
    assert {(x.doc_id, k) for x in found for k in range(x.start_word, x.end_word)} == truth


def test_adjacent_passages_of_different_documents_are_decided_apart(spark):
    r = random.Random(33)
    x, y = prose(r, 70), prose(r, 80)
    rows = [(5, prose(r, 20) + x + prose(r, 20)), (9, prose(r, 30) + x + y + prose(r, 10)), (12, y + prose(r, 40))]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")
    found = sorted((z.doc_id, z.start_word, z.end_word, z.n_words, z.other_doc_id, z.keeper) for z in p.repeated_passages(docs).collect())
    assert found == [(5, 20, 90, 70, 9, True), (9, 30, 100, 70, 5, False), (9, 100, 180, 80, 12, True), (12, 0, 80, 80, 9, False)]
    left = {z.doc_id: z.text for z in p.without_repeats(docs).collect()}
    assert " ".join(y) in left[9] and " ".join(x) in left[5]
    assert " ".join(x) not in left[9] and left[12] == " ".join(rows[2][1][80:])
