"""Base spans against the agreed patterns as written; contexts that are learned."""

import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from placerank.llm import pii
from placerank.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.01"
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text):
            digits = re.sub(r"[^0-9]", "", m.group())
            good = {
                "email": True,
                "ip": kind == "ip" and all(int(p) <= 255 for p in m.group().split(".")) if kind == "ip" else True,
                "card": 12 <= len(digits) <= 19 and sum(
                    sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(digits[::-1])) % 10 == 0,
                "phone": 9 <= len(digits) <= 15,
            }[kind]
            if good:
                out.append((kind, *m.span()))
    return sorted(out, key=lambda s: (s[1], pii.KINDS.index(s[0])))


BITS = ["a", "@", ".", "b.c", "-", "1", "12.3", ".4.5", "4111 1111 1111 1111", "+1 (017) 555-5036", " ", "é", "+",
        "10.0.0.1", "x@y.zz", "999", "(", "%"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(BITS), max_size=14).map("".join))
def test_base_spans(text):
    assert pii.base_spans(text) == plain_spans(text)


def test_long_runs_take_linear_time():
    assert pii.base_spans("a" * 200_000 + "@" + "1" * 200_000) == []
    assert pii.base_spans("1." * 100_000 + "@") is not None


def test_query(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    rows = QUERIES["op8_personal_data"](spark, FOLDER).collect()
    assert len(rows) == len(docs)
    for r in rows:
        base = plain_spans(docs[r.doc_id])
        line = ",".join(f"{k}:{s}:{e}" for k, s, e in base)
        assert r.base_sha256 == hashlib.sha256(line.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == kind for k, _, _ in base) for kind in pii.KINDS]
        assert set(line.split(",")) - {""} <= set(r.spans.split(","))


def test_contexts_find_unseen_identifiers(spark):
    rows = [(i, f"hello there, my mail is user{i}@host{i}.example.com and so on") for i in range(12)]
    rows += [(20, "hello there, my mail is someone@intranet and so on"), (21, "order 55512 of today is someone@intranet."),
             (22, "a plain text with number 12345 inside"), (23, None), (24, ""), (None, "call +49 30 1234567 now"),
             (25, "word " * 60_000), (20, "hello there, my mail is someone@intranet and so on")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, Spans int")
    found = pii.find_personal_data(docs).select("doc_id", pii.written_spans("spans").alias("s")).collect()
    got = {r.doc_id: r.s for r in found}
    assert len(found) == len(rows)
    assert got[20] == "email:24:40" and got[21] == "email:24:40"
    assert got[22] == got[23] == got[24] == got[25] == "" and got[None] == "phone:5:19"
    assert got[3] == "email:24:47"
    assert pii.find_personal_data(docs.limit(0)).count() == 0
