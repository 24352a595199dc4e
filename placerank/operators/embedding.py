"""Text and scores as one unit vector per listing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import (
    IDF,
    BucketedRandomProjectionLSH,
    BucketedRandomProjectionLSHModel,
    HashingTF,
    Normalizer,
    RegexTokenizer,
    StopWordsRemover,
    VectorAssembler,
)
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placerank.constants import (
    ENGLISH_STOP_WORDS,
    LSH_BUCKET_LENGTH,
    LSH_TABLES,
    SCORE_COLUMNS,
    TEXT_BUCKETS,
    TEXT_COLUMNS,
)
from placerank.functions.expressions import environment_columns, present
from placerank.sources.scratch import written

_WORD_BREAK = r"\W+"
_MIN_WORD = 2


def combined_text(columns: Sequence[str]) -> Column:
    """Text columns in one lower-case line; nulls count as empty."""
    if not columns:
        return F.lit("")
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]
    return F.lower(F.trim(F.concat_ws(" ", *parts)))


def with_text(df: DataFrame, columns: Sequence[str] = tuple(TEXT_COLUMNS)) -> DataFrame:
    return df.withColumn("text_all", combined_text(present(df, columns)))


def fit_embedding(
    df: DataFrame,
    text_columns: Sequence[str] = tuple(TEXT_COLUMNS),
    buckets: int = TEXT_BUCKETS,
) -> PipelineModel:
    """Fit word weights over all countries; the model turns ``with_text`` rows to vectors.

    The vector holds the scores, the environment and the hashed words, in that
    order, scaled to length 1.  Only the word weights need a pass over the data.
    """
    numbers = present(df, SCORE_COLUMNS) + environment_columns(df.columns)
    words = [
        RegexTokenizer(
            inputCol="text_all", outputCol="words", pattern=_WORD_BREAK, minTokenLength=_MIN_WORD
        ),
        StopWordsRemover(
            inputCol="words", outputCol="kept_words", stopWords=ENGLISH_STOP_WORDS
        ),
        HashingTF(inputCol="kept_words", outputCol="word_counts", numFeatures=buckets),
        IDF(inputCol="word_counts", outputCol="word_weights"),
    ]
    vector = VectorAssembler(
        inputCols=[*numbers, "word_weights"], outputCol="features", handleInvalid="keep"
    )
    unit = Normalizer(inputCol="features", outputCol="features_norm", p=2.0)
    return Pipeline(stages=[*words, vector, unit]).fit(with_text(df, text_columns))


def embed(
    df: DataFrame, model: PipelineModel, text_columns: Sequence[str] = tuple(TEXT_COLUMNS)
) -> DataFrame:
    """``property_id``, ``addr_cc`` and ``features_norm``."""
    keys = present(df, ["property_id", "addr_cc"])
    return model.transform(with_text(df, text_columns)).select(*keys, "features_norm")


def fit_lsh(
    embedded: DataFrame,
    bucket_length: float = LSH_BUCKET_LENGTH,
    tables: int = LSH_TABLES,
    seed: int | None = None,
) -> BucketedRandomProjectionLSHModel:
    """A random-projection index.

    Components of a unit vector in many dimensions project to about
    ``1/sqrt(dimensions)``, so the default bucket length prunes little; a length
    of that order makes the index selective at the price of recall.
    """
    index = BucketedRandomProjectionLSH(
        inputCol="features_norm", outputCol="hashes",
        bucketLength=bucket_length, numHashTables=tables,
    )
    if seed is not None:
        index = index.setSeed(seed)
    return index.fit(embedded)


def approximate_nearest(
    embedded: DataFrame, target_id, country: str, index: BucketedRandomProjectionLSHModel, n: int
) -> DataFrame | None:
    """The index's own single-probe search; None if the listing has no vector."""
    key = embedded.where(F.col("property_id") == target_id).select("features_norm").first()
    if key is None:
        return None
    candidates = embedded.where(
        (F.col("addr_cc") == country) & (F.col("property_id") != target_id)
    )
    return index.approxNearestNeighbors(candidates, key["features_norm"], n, distCol="l2_dist")


# --- the exact form: real words instead of hashed buckets ---------------------
def words(df: DataFrame, text: str = "text_all") -> DataFrame:
    """One row per listing and distinct word with its number of occurrences.

    Texts are dealt out by listing, so words are counted where they are cut and no word is
    dealt out.  The number of parts is fixed, as texts become many times their bytes in rows.
    Short words are left out after they are rows, as Spark interprets functions over arrays.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (
        df.select("property_id", "addr_cc", F.col(text).alias("text"))
        .repartition(parts, "property_id", "addr_cc")
        .select("property_id", "addr_cc", F.explode(F.split(F.lower("text"), _WORD_BREAK)).alias("term"))
        .where((F.length("term") >= _MIN_WORD) & ~F.col("term").isin(ENGLISH_STOP_WORDS))
        .groupBy("property_id", "addr_cc", "term")
        .agg(F.count("*").alias("tf"))
    )


def word_weights(counted: DataFrame, n_listings: Column) -> DataFrame:
    """``idf`` of every word: ``ln((listings + 1) / (listings with the word + 1))``."""
    return counted.groupBy("term").agg(
        F.log((n_listings + 1.0) / (F.count("*") + 1.0)).alias("idf")
    )


def tf_idf(df: DataFrame, text: str = "text_all") -> DataFrame:
    """``tf``, ``idf`` and ``weight`` of every word of every listing.

    Word counts are written once, as both the weights and the join read them.
    The vocabulary is joined by size: broadcast while its files are small,
    otherwise by sort-merge with splitting of the most frequent words.
    """
    counted = written(words(df, text), "words")
    listings = df.agg(F.count("*")).scalar()
    weights = written(word_weights(counted, listings), "weights")
    return counted.join(weights, "term").withColumn("weight", F.col("tf") * F.col("idf"))


def word_vectors(weighted: DataFrame) -> DataFrame:
    """Unit vectors as (``indices``, ``values``), words in the order of their hash.

    A listing's words are bounded by its own text, so the lists are too.
    """
    terms = F.sort_array(
        F.collect_list(F.struct(F.xxhash64("term").alias("i"), F.col("weight").alias("w")))
    )
    length = F.sqrt(F.sum(F.col("weight") * F.col("weight")))
    return (
        weighted.groupBy("property_id", "addr_cc")
        .agg(terms.alias("terms"), length.alias("norm"))
        .select(
            "property_id",
            "addr_cc",
            F.transform("terms", lambda t: t["i"]).alias("indices"),
            F.transform(
                "terms", lambda t: F.coalesce(F.try_divide(t["w"], F.col("norm")), F.lit(0.0))
            ).alias("values"),
        )
    )
