"""Embedding and nearest neighbours."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import query, rounded
from checks.score_queries import SCORE_STEPS, SCORE_VIEWS, score_sql, scored
from checks.views import view
from placerank.constants import ENGLISH_STOP_WORDS, TARGET_COUNTRIES
from placerank.functions.expressions import cosine_from_l2
from placerank.operators import browsing, embedding, neighbours, pivots, probing, ranking
from placerank.operators.nested import neighbour_lists
from placerank.operators.ranking import Preferences
from placerank.plans.offline import precompute_neighbours
from placerank.plans.online import recommend
from placerank.sources.scratch import written

_DISTANCE = "round(list_distance(s.features_norm, c.features_norm), 6)"
_SAMPLE = "SELECT * FROM vectors ORDER BY md5('7|' || property_id), CAST(property_id AS STRING) LIMIT 500"
_COUNTRY_LIST = ", ".join(f"'{c}'" for c in TARGET_COUNTRIES)
_PAIRED = f"""SELECT s.property_id AS src_property_id, c.property_id AS neighbor_property_id,
  c.addr_cc AS target_cc, {_DISTANCE} AS l2_dist
FROM {{sources}} s JOIN vectors c ON s.property_id <> c.property_id WHERE c.addr_cc IN ({_COUNTRY_LIST})"""
_NEAREST = """SELECT * FROM paired QUALIFY row_number() OVER
  (PARTITION BY src_property_id, target_cc ORDER BY l2_dist, neighbor_property_id) <= 50"""
NEIGHBOUR_STEPS = {
    "sampled": _SAMPLE, "paired": _PAIRED.format(sources="sampled"), "nearest": _NEAREST,
}


def sample(spark, folder):
    """500 listings in seeded order, the picker's sample."""
    return browsing.sample_listings(view(spark, folder, "vectors"), 500, seed=7).select(
        F.col("property_id").cast("long").alias("property_id")
    )


@query(
    "sample_listings", ["listings"],
    """SELECT CAST(property_id AS STRING) AS property_id, addr_cc, listing_title, room_type_text, addr_name,
  price_per_night, ratings FROM listings ORDER BY md5('7|' || property_id) LIMIT 500""",
)
def sample_listings(spark, folder):
    return browsing.sample_listings(view(spark, folder, "listings"), 500, seed=7)


@query("vec_knn_batch", ["vectors"], "SELECT * FROM nearest", NEIGHBOUR_STEPS)
def vec_knn_batch(spark, folder):
    requests = neighbours.every_country(sample(spark, folder), TARGET_COUNTRIES)
    return neighbours.nearest_neighbours(view(spark, folder, "vectors"), requests, 50)


@query(
    "vec_knn", ["vectors"],
    f"""SELECT c.property_id, c.addr_cc, {_DISTANCE} AS l2_dist FROM vectors s, vectors c
WHERE s.property_id = 3 AND c.property_id <> 3 AND c.addr_cc = 'IT' ORDER BY l2_dist, c.property_id LIMIT 50""",
)
def vec_knn(spark, folder):
    return neighbours.retrieve(view(spark, folder, "vectors"), 3, "IT", 50)


@query(
    "cosine_from_l2", ["vectors"],
    f"""SELECT c.property_id, round(1 - power({_DISTANCE}, 2) / 2, 6) AS cosine_similarity
FROM vectors s, vectors c WHERE s.property_id = 3 AND c.property_id <> 3 AND c.addr_cc = 'FR'
ORDER BY {_DISTANCE}, c.property_id LIMIT 50""",
)
def cosine(spark, folder):
    found = neighbours.retrieve(view(spark, folder, "vectors"), 3, "FR", 50)
    return found.select("property_id", F.round(cosine_from_l2(F.col("l2_dist")), 6).alias("cosine_similarity"))


@query("knn_top_pairs", ["vectors"], "SELECT * FROM nearest", NEIGHBOUR_STEPS)
def knn_top_pairs(spark, folder):
    """The top of already measured pairs: more than needed per source, cut again."""
    requests = neighbours.every_country(sample(spark, folder), TARGET_COUNTRIES)
    wide = neighbours.nearest_neighbours(
        view(spark, folder, "vectors"), requests, 60, drop_self=False
    )
    return neighbours.top_neighbours(wide, 50)


@query("knn_pivots", ["vectors"], "SELECT * FROM nearest", NEIGHBOUR_STEPS)
def knn_pivots(spark, folder):
    """The exact search by pivots and bounds."""
    requests = neighbours.every_country(sample(spark, folder), TARGET_COUNTRIES)
    return pivots.pivot_neighbours(view(spark, folder, "vectors"), requests, 50, pivots=8)


# --- hashed index ----------------------------------------------------------------
def _indexed(spark, folder):
    from pyspark.ml.functions import array_to_vector

    vectors = view(spark, folder, "vectors").withColumn(
        "features_norm", array_to_vector("features_norm")
    )
    index = embedding.fit_lsh(vectors, seed=11)
    return vectors, index


@query("lsh_neighbours")
def lsh_neighbours(spark, folder):
    """Nearest among the listings that share a bucket with the source."""
    vectors, index = _indexed(spark, folder)
    requests = neighbours.every_country(sample(spark, folder), TARGET_COUNTRIES)
    return neighbours.nearest_neighbours(index.transform(vectors), requests, 50, shared_buckets=True)


@query("lsh_neighbours_wide", ["vectors"], "SELECT * FROM nearest", NEIGHBOUR_STEPS)
def lsh_neighbours_wide(spark, folder):
    """One bucket for all listings: the join on buckets then finds the exact nearest."""
    from pyspark.ml.functions import array_to_vector

    bucket = F.array(array_to_vector(F.array(F.lit(0.0))))
    hashed = view(spark, folder, "vectors").withColumn("hashes", bucket)
    requests = neighbours.every_country(sample(spark, folder), TARGET_COUNTRIES)
    return neighbours.nearest_neighbours(hashed, requests, 50, shared_buckets=True)


_POSSIBLE = f"SELECT count(*) FROM sampled s JOIN vectors c ON s.property_id <> c.property_id WHERE c.addr_cc IN ({_COUNTRY_LIST})"


@query(
    "lsh_recall", ["vectors"],
    f"""SELECT count(*) AS n_true, ({_POSSIBLE}) AS n_possible, true AS recall_reached, true AS pruned
FROM (SELECT * FROM paired QUALIFY row_number() OVER
  (PARTITION BY src_property_id, target_cc ORDER BY l2_dist, neighbor_property_id) <= 10)""",
    {k: NEIGHBOUR_STEPS[k] for k in ("sampled", "paired")},
)
def lsh_recall(spark, folder):
    """Multi-probe search against the exact one: nine tenths of it, from fewer pairs than there are."""
    vectors = view(spark, folder, "vectors")
    requests = neighbours.every_country(sample(spark, folder), TARGET_COUNTRIES)
    index = probing.build_probe_index(vectors, width=1.5, tables=4, functions=4)
    looked_at = probing.measured_probes(index, requests, 10, 0.95)
    lists = written(probing.probed_lists(index, requests, looked_at), "lists")
    found = probing.nearest_of_lists(index, requests, lists, 10)
    ids = ["src_property_id", "neighbor_property_id", "target_cc"]
    true = neighbours.nearest_neighbours(vectors, requests, 10).select(*ids)
    met = true.join(found.select(*ids, F.lit(1).alias("met")), ids, "left")
    possible = requests.join(
        vectors.select(F.col("property_id").alias("other_id"), F.col("addr_cc").alias("target_cc")), "target_cc"
    ).where("property_id <> other_id").agg(F.count("*")).scalar()
    measured = lists.agg(F.sum(F.size("sources"))).scalar()
    return (
        met.agg(F.count("*").alias("n_true"), F.count("met").alias("n_met"))
        .withColumns({"n_possible": possible, "n_measured": measured})
        .select(
            "n_true", "n_possible", (F.col("n_met") >= 0.9 * F.col("n_true")).alias("recall_reached"),
            (F.col("n_measured") < 0.95 * F.col("n_possible")).alias("pruned"),
        )
    )


@query("lsh_single")
def lsh_single(spark, folder):
    """The index's own approximate search for one listing."""
    vectors, index = _indexed(spark, folder)
    found = embedding.approximate_nearest(vectors, 3, "IT", index, 50)
    return found.select("property_id", "addr_cc", F.round("l2_dist", 6).alias("l2_dist"))


# --- text ------------------------------------------------------------------------------
_STOP = ", ".join("'" + w.replace("'", "''") + "'" for w in ENGLISH_STOP_WORDS)
TEXT_STEPS = {
    "tokens": r"""SELECT property_id, addr_cc, unnest(regexp_split_to_array(lower(text_all), '[^a-z0-9_]+')) AS term
FROM text_listings""",
    "counted": f"""SELECT property_id, addr_cc, term, count(*) AS tf FROM tokens
WHERE length(term) >= 2 AND term NOT IN ({_STOP}) GROUP BY 1, 2, 3""",
    "weights": """SELECT term, ln(((SELECT count(*) FROM text_listings) + 1.0e0) / (count(*) + 1.0e0)) AS idf
FROM counted GROUP BY term""",
    "weighted": "SELECT *, tf * idf AS weight FROM counted JOIN weights USING (term)",
    "normed": """SELECT *, weight / sqrt(sum(weight * weight) OVER (PARTITION BY property_id)) AS w FROM weighted""",
}


def _texts(spark, folder):
    return view(spark, folder, "text_listings")


@query(
    "word_weights", ["text_listings"], "SELECT term, round(idf, 6) AS idf FROM weights",
    {k: TEXT_STEPS[k] for k in ("tokens", "counted", "weights")},
)
def word_weights(spark, folder):
    listings = _texts(spark, folder)
    counted = embedding.words(listings)
    n = listings.agg(F.count("*")).scalar()
    return rounded(embedding.word_weights(counted, n), "idf")


@query(
    "tfidf", ["text_listings"],
    "SELECT property_id, term, tf, round(weight, 6) AS weight FROM weighted",
    {k: TEXT_STEPS[k] for k in ("tokens", "counted", "weights", "weighted")},
)
def tfidf(spark, folder):
    weighted = embedding.tf_idf(_texts(spark, folder))
    return rounded(weighted.select("property_id", "term", "tf", "weight"), "weight")


_TEXT_COUNTRIES = ["GB", "FR", "DE", "ES"]


@query(
    "text_knn", ["text_listings"],
    """SELECT src_property_id, neighbor_property_id, target_cc, l2_dist FROM (
  SELECT p.src_property_id, p.neighbor_property_id, p.target_cc,
    round(sqrt(greatest(0, 2 - 2 * coalesce(dot, 0))), 6) AS l2_dist
  FROM everyone p LEFT JOIN dots USING (src_property_id, neighbor_property_id))
QUALIFY row_number() OVER (PARTITION BY src_property_id, target_cc ORDER BY l2_dist, neighbor_property_id) <= 50""",
    TEXT_STEPS | {
        "known": "SELECT DISTINCT property_id, addr_cc FROM counted",
        "asked": "SELECT property_id FROM text_listings ORDER BY md5('3|' || property_id) LIMIT 500",
        "everyone": """SELECT a.property_id AS src_property_id, k.property_id AS neighbor_property_id,
    k.addr_cc AS target_cc FROM asked a SEMI JOIN known USING (property_id)
    JOIN known k ON a.property_id <> k.property_id""",
        "dots": """SELECT a.property_id AS src_property_id, b.property_id AS neighbor_property_id,
    sum(a.w * b.w) AS dot FROM normed a JOIN normed b ON a.term = b.term AND a.property_id <> b.property_id
    WHERE a.property_id IN (SELECT property_id FROM asked) GROUP BY 1, 2""",
    },
)
def text_knn(spark, folder):
    listings = _texts(spark, folder)
    vectors = written(embedding.word_vectors(embedding.tf_idf(listings)), "vectors")
    asked = browsing.sample_listings(listings, 500, seed=3).select(
        F.col("property_id").cast("long").alias("property_id")
    )
    requests = neighbours.every_country(asked, _TEXT_COUNTRIES)
    return neighbours.nearest_neighbours(vectors, requests, 50, vector="values")


# Scores and surroundings of every listing, in the order in which the vector holds them.
_NUMBERS = {
    "price_score": "(property_id % 7 + 1) / 7.0e0",
    "property_quality": "(property_id % 5) / 5.0e0",
    "host_quality": "(property_id % 3 + 1) / 4.0e0",
    "env_food_norm": "(property_id % 11) / 11.0e0",
    "env_nature_norm": "(property_id % 13) / 13.0e0",
}
_N = len(_NUMBERS)


@query(
    "embedding_pipeline", ["text_listings"],
    f"""SELECT property_id, addr_cc, {262144 + _N} AS width, 1.0e0 AS norm, coalesce(n_words, 0) AS n_words,
  {', '.join(f'round({e}, 6) AS {c}' for c, e in _NUMBERS.items())}
FROM text_listings LEFT JOIN (SELECT property_id, sum(tf) AS n_words FROM counted GROUP BY 1) USING (property_id)""",
    {k: TEXT_STEPS[k] for k in ("tokens", "counted")},
)
def embedding_pipeline(spark, folder):
    """Every part of the vector: its width and length, the numbers in front, the hashed words."""
    listings = _texts(spark, folder).withColumnRenamed("text_all", "description")
    numbered = listings.selectExpr("*", *[f"double({e}) AS {c}" for c, e in _NUMBERS.items()])
    model = embedding.fit_embedding(numbered)
    whole = model.transform(embedding.with_text(numbered)).select(
        "property_id", "addr_cc",
        F.unwrap_udt("features").alias("f"),
        F.unwrap_udt("features_norm").alias("u"),
        F.unwrap_udt("word_counts")["values"].alias("counts"),
    )
    front = F.filter(F.arrays_zip("f.indices", "f.values"), lambda e: e["indices"] < _N)
    known = F.map_from_entries(front)

    def total(values, square=False):
        return F.aggregate(values, F.lit(0.0), lambda a, v: a + (v * v if square else v))

    return whole.select(
        "property_id", "addr_cc",
        F.coalesce("u.size", F.size("u.values")).alias("width"),
        F.round(F.sqrt(total(F.col("u.values"), True)), 6).alias("norm"),
        total(F.col("counts")).cast("long").alias("n_words"),
        *[
            F.round(F.coalesce(F.try_element_at(known, F.lit(i)), F.lit(0.0)), 6).alias(c)
            for i, c in enumerate(_NUMBERS)
        ],
    )


# --- recommend -----------------------------------------------------------------------------
_WEIGHTS = {"price_score": 2, "property_quality": 3, "env_food_norm": 5}
_PREFS = Preferences(price=2, property=3, env={"env_food": 5})


@query(
    "recommend", ["vectors", *SCORE_VIEWS],
    f"""SELECT property_id, listing_title, l2_dist, {score_sql(_WEIGHTS)} AS final_score
FROM (SELECT c.property_id, {_DISTANCE} AS l2_dist FROM vectors s, vectors c
  WHERE s.property_id = 3 AND c.property_id <> 3 AND c.addr_cc = 'ES' ORDER BY l2_dist, c.property_id LIMIT 50)
JOIN scored USING (property_id) ORDER BY final_score DESC, l2_dist, property_id LIMIT 10""",
    SCORE_STEPS,
)
def recommend_one(spark, folder):
    best = recommend(view(spark, folder, "vectors"), scored(spark, folder), 3, "ES", _PREFS)
    return rounded(best.select("property_id", "listing_title", "l2_dist", "final_score"), "final_score")


_STORED = [
    "src_property_id", "target_cc", "neighbor_property_id", "l2_dist", "listing_title",
    "price_score", "env_food_norm", "budget_level",
]


@query(
    "neighbours_with_scores", ["vectors", *SCORE_VIEWS],
    f"""SELECT {', '.join(c for c in _STORED if c not in ('price_score', 'env_food_norm'))},
  round(price_score, 6) AS price_score, round(env_food_norm, 6) AS env_food_norm
FROM nearest LEFT JOIN scored ON neighbor_property_id = property_id""",
    NEIGHBOUR_STEPS | SCORE_STEPS,
)
def neighbours_with_scores(spark, folder):
    stored = precompute_neighbours(
        view(spark, folder, "vectors"), scored(spark, folder), sample(spark, folder)
    )
    return rounded(stored.select(*_STORED), "price_score", "env_food_norm")


@query(
    "neighbours_nested", ["vectors"],
    """SELECT src_property_id, target_cc, row_number() OVER (PARTITION BY src_property_id, target_cc
  ORDER BY l2_dist, neighbor_property_id) AS place, neighbor_property_id, l2_dist FROM nearest""",
    NEIGHBOUR_STEPS,
)
def neighbours_nested(spark, folder):
    """Nested lists per source and country, unnested with their position."""
    nested = neighbour_lists(vec_knn_batch(spark, folder), 50)
    flat = nested.select("src_property_id", "target_cc", F.posexplode("results").alias("place", "r"))
    return flat.select("src_property_id", "target_cc", F.col("place") + 1, "r.*").withColumnRenamed(
        "(place + 1)", "place"
    )


@query(
    "recommend_batch", ["vectors", *SCORE_VIEWS],
    """SELECT request_id, neighbor_property_id, final_score FROM (
  SELECT request_id, neighbor_property_id, l2_dist, k, round((coalesce(price_score, 0) * w_price
    + coalesce(host_quality, 0) * w_host + coalesce(env_nature_norm, 0) * w_nature) / (w_price + w_host + w_nature), 6)
    AS final_score
  FROM asked JOIN nearest USING (src_property_id, target_cc)
  LEFT JOIN scored ON neighbor_property_id = property_id)
QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY final_score DESC, l2_dist, neighbor_property_id) <= 10""",
    NEIGHBOUR_STEPS | SCORE_STEPS | {
        "asked": """SELECT property_id || '-' || target_cc AS request_id, property_id AS src_property_id, target_cc,
  1 + property_id % 5 AS w_price, 1 + property_id % 3 AS w_host, 1 + property_id % 7 AS w_nature, 10 AS k
FROM sampled, (SELECT unnest(['FR', 'DE']) AS target_cc)""",
    },
)
def recommend_batch(spark, folder):
    stored = precompute_neighbours(
        view(spark, folder, "vectors"), scored(spark, folder), sample(spark, folder)
    )
    none = F.lit(None)
    requests = neighbours.every_country(sample(spark, folder), ["FR", "DE"]).select(
        F.concat_ws("-", "property_id", "target_cc").alias("request_id"),
        F.col("property_id").alias("src_property_id"),
        "target_cc",
        (1 + F.col("property_id") % 5).alias("w_price"),
        F.lit(0).alias("w_property"),
        (1 + F.col("property_id") % 3).alias("w_host"),
        F.lit(0).alias("w_temp"),
        F.lit(0).alias("w_budget"),
        F.create_map(F.lit("env_nature"), 1 + F.col("property_id") % 7).alias("env_weights"),
        none.cast("double").alias("temp_pref"),
        none.cast("int").alias("travel_month"),
        none.cast("string").alias("budget_pref"),
        F.lit(10).alias("k"),
    )
    best = ranking.rank_requests(stored, requests)
    return rounded(best.select("request_id", "neighbor_property_id", "final_score"), "final_score")
