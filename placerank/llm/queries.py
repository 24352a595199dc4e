"""The operators over their whole tables, with the results that were agreed on."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from placerank.llm import (
    clusters,
    collocations,
    decontamination,
    jaccard_join,
    language,
    mixing,
    passages,
    pii,
    quality,
    sharding,
    tokens,
    vector_forest,
    wrappers,
)
from placerank.llm.common import table, word_count
from placerank.sources.scratch import written

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(run):
        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql
        return run

    return register


@query("op4_mix_sources")
def op4_mix_sources(spark, folder):
    sizes = written(
        table(spark, folder, "documents").select("doc_id", "source", word_count("text").alias("words")),
        "sizes",
    )
    mixed = mixing.mix_sources(sizes, size="words", keep=["doc_id", "source"])
    return mixed.select(
        "doc_id", "size", "source_size", "target",
        (F.col("copies") * F.col("size")).alias("taken"), "copies", "source",
    )


@query("op9_shard_by_key")
def op9_shard_by_key(spark, folder):
    docs = table(spark, folder, "documents")
    return sharding.assign_shards(docs, shards=40, keep=["doc_id"]).select(
        "doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"
    )


@query("op3_token_counts")
def op3_token_counts(spark, folder):
    docs = table(spark, folder, "documents")
    return tokens.count_tokens(docs, VOCABULARY, keep=["doc_id"])


_BENCH_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query(
    "op2_find_benchmark",
    f"""WITH docs AS (SELECT doc_id, regexp_extract_all({_LOWER.format("text")}, '{_BENCH_WORD}') AS w FROM documents),
items AS (SELECT item_id, regexp_extract_all({_LOWER.format("text")}, '{_BENCH_WORD}') AS w FROM benchmark),
patterns AS (SELECT DISTINCT item_id, p FROM (SELECT item_id,
  unnest([w[i : i + 9] FOR i IN range(1, greatest(2, len(w) - 8))]) AS p FROM items WHERE len(w) > 0)),
lengths AS (SELECT DISTINCT len(p) AS n FROM patterns),
runs AS (SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS i, w FROM docs, lengths WHERE len(w) >= n),
hits AS (SELECT doc_id, n, i, item_id FROM (SELECT doc_id, n, i, w[i : i + n - 1] AS p FROM runs) JOIN patterns USING (p)),
covered AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (
  SELECT doc_id, unnest(range(i, i + n)) AS k FROM hits) GROUP BY 1),
listed AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (
  SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits WHERE item_id IS NOT NULL) GROUP BY 1)
SELECT doc_id, CAST(coalesce(len(w), 0) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit,
  coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN covered USING (doc_id) LEFT JOIN listed USING (doc_id)""",
)
def op2_find_benchmark(spark, folder):
    docs, benchmark = table(spark, folder, "documents"), table(spark, folder, "benchmark")
    found = decontamination.find_benchmark(docs, benchmark, keep=["doc_id"])
    n_hit = decontamination.hit_words()
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


_WORD = r"[^\x20\x09-\x0D]+"


@query(
    "op10_jaccard_join",
    f"""WITH RECURSIVE docs AS (
  SELECT doc_id, coalesce(regexp_extract_all({_LOWER.format("text")}, '{_WORD}'), []) AS w FROM documents),
shingles AS (SELECT DISTINCT doc_id, s FROM (SELECT doc_id,
  unnest([array_to_string(w[i : i + 4], ' ') FOR i IN range(1, greatest(2, len(w) - 3))]) AS s FROM docs WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY 1),
shared AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM shingles a JOIN shingles b USING (s)
  WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT u, v FROM shared JOIN sizes a ON a.doc_id = u JOIN sizes b ON b.doc_id = v
  WHERE 100 * c >= 80 * (a.n + b.n - c)),
reached AS (SELECT doc_id AS a, doc_id AS b FROM docs UNION
  SELECT r.a, l.v FROM reached r JOIN links l ON r.b = l.u)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id FROM docs LEFT JOIN sizes USING (doc_id)
JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reached GROUP BY 1) USING (doc_id)""",
)
def op10_jaccard_join(spark, folder):
    return jaccard_join.jaccard_components(table(spark, folder, "documents"))


@query("op6_language")
def op6_language(spark, folder):
    docs = table(spark, folder, "documents")
    model = language.learn(docs)
    asked = docs.select("doc_id", language.held_out("doc_id").alias("held_out"), "text")
    return language.identify(asked, model, keep=["doc_id", "held_out"])


@query("op1_quality_rules")
def op1_quality_rules(spark, folder):
    docs = table(spark, folder, "documents")
    return quality.judge(docs, keep=["doc_id"]).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", F.array_join("failed_measures", ",").alias("failed_measures"),
    )


@query("op5_substring_dedup")
def op5_substring_dedup(spark, folder):
    return passages.repeated_passages(table(spark, folder, "documents"))


@query("op8_personal_data")
def op8_personal_data(spark, folder):
    found = pii.find_personal_data(table(spark, folder, "documents"), keep=["doc_id"])
    return found.select(
        "doc_id",
        *[pii.count_kind(kind).alias(f"n_{kind}") for kind in pii.KINDS],
        F.sha2(pii.written_spans("base_spans"), 256).alias("base_sha256"),
        pii.written_spans("spans").alias("spans"),
    )


@query("op7_article_text")
def op7_article_text(spark, folder):
    pages = table(spark, folder, "pages")
    return wrappers.extract_articles(pages, keep=["page_id", "url"])


@query("op11_nearest_vectors")
def op11_nearest_vectors(spark, folder):
    vectors = table(spark, folder, "embeddings")
    return vector_forest.nearest_vectors(vectors, vectors.where("vec_id % 100 = 0"), k=10)


def _clustering_sql(k: int = 8, rounds: int = 10) -> str:
    """Ten rounds as common tables: ``at<i>`` are centroids by dimension, ``to<i>`` the nearest ones."""
    whole = "[CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding]"
    steps = [
        f"""kept AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, {whole} AS w FROM embeddings
WHERE len(embedding) = 64 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0)""",
        "dims AS MATERIALIZED (SELECT r, unnest(range(1, 65)) AS d, unnest(w) AS v FROM kept)",
        f"""at0 AS MATERIALIZED (SELECT c, unnest(range(1, 65)) AS d, unnest(w) AS v FROM (
SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1 AS c, w FROM kept
ORDER BY sha256('3:' || vec_id) LIMIT {k}))""",
    ]
    for i in range(rounds + 1):
        steps.append(
            f"""to{i} AS MATERIALIZED (SELECT r, c, distance FROM (
SELECT r, c, sum((x.v - y.v) * (x.v - y.v)) AS distance FROM dims x JOIN at{i} y USING (d) GROUP BY ALL)
QUALIFY row_number() OVER (PARTITION BY r ORDER BY distance, c) = 1)"""
        )
        if i < rounds:
            steps.append(
                f"""at{i + 1} AS MATERIALIZED (SELECT o.c, o.d, CAST(coalesce((s - ((s % n) + n) % n) // n, o.v) AS BIGINT) AS v
FROM at{i} o LEFT JOIN (SELECT c, d, sum(v) AS s, count(*) AS n FROM to{i} JOIN dims USING (r) GROUP BY ALL) m
ON m.c = o.c AND m.d = o.d)"""
            )
    last = rounds
    return f"""WITH {", ".join(steps)}
SELECT vec_id, CAST(c AS INTEGER) AS cluster, CAST(distance AS BIGINT) AS distance,
  CAST(sum(distance) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia,
  CAST(sum(distance) OVER () AS BIGINT) AS inertia, sha AS centroid_sha256
FROM to{last} JOIN kept USING (r)
JOIN (SELECT c, sha256(string_agg(v, ',' ORDER BY d)) AS sha FROM at{last} GROUP BY c) USING (c)"""


@query("op12_cluster_vectors", _clustering_sql())
def op12_cluster_vectors(spark, folder):
    found = clusters.cluster_vectors(table(spark, folder, "embeddings"))
    digest = F.sha2(F.array_join(F.col("centroid").cast("array<string>"), ","), 256)
    return found.select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", digest.alias("centroid_sha256")
    )


_PHRASE_WORD = r"[^\x20\x09]+"


@query(
    "op13_collocations",
    f"""WITH pieces AS (SELECT coalesce(lang, 'und') AS lang,
  unnest(regexp_split_to_array({_LOWER.format("text")}, '[.,;:!?\x0A-\x0D]')) AS p FROM documents),
lines AS MATERIALIZED (SELECT lang, regexp_extract_all(p, '{_PHRASE_WORD}') AS w FROM pieces),
grams AS MATERIALIZED (SELECT lang, w, count(*) AS f FROM (
  SELECT lang, unnest([w[i : i + k - 1] FOR i IN range(1, len(w) - k + 2)]) AS w
  FROM lines, (SELECT unnest(range(1, 5)) AS k) WHERE len(w) >= k) GROUP BY ALL),
totals AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM lines GROUP BY 1),
candidates AS (SELECT lang, w, f AS a FROM grams WHERE len(w) > 1 AND f >= 30),
cuts AS (SELECT c.lang, c.w, a, k, x.f AS l, y.f AS r,
  CAST((CAST(2000000 AS HUGEINT) * a) // (x.f + y.f) AS BIGINT) AS score
  FROM (SELECT *, unnest(range(1, len(w))) AS k FROM candidates) c
  JOIN grams x ON x.lang = c.lang AND x.w = c.w[1 : k] JOIN grams y ON y.lang = c.lang AND y.w = c.w[k + 1 :]
  QUALIFY row_number() OVER (PARTITION BY c.lang, c.w ORDER BY score, k) = 1),
inner_ AS (SELECT lang, w, max(a) AS around FROM (
  SELECT lang, a, unnest([w[i : i + s - 1] FOR i IN range(1, len(w) - s + 2)]) AS w
  FROM candidates, (SELECT unnest(range(2, 4)) AS s) WHERE len(w) > s) GROUP BY ALL)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(w, ' ')) AS rank,
  array_to_string(w, ' ') AS phrase, a, l, r, n, score
FROM cuts LEFT JOIN inner_ USING (lang, w) JOIN totals USING (lang)
WHERE around IS NULL OR 100 * around < 80 * a
QUALIFY rank <= 2000""",
)
def op13_collocations(spark, folder):
    return collocations.collocations(table(spark, folder, "documents"))
