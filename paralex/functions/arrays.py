"""Arrays of token ids and of vector components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SENTINEL = -100


def mask_sentinel(ids: Column, pad_id: int, sentinel: int = SENTINEL) -> Column:
    """Sentinels become the pad id."""
    return F.transform(ids, lambda x: F.when(x == sentinel, F.lit(pad_id)).otherwise(x))


def truncate_pad(ids: Column, length: int, pad_id: int) -> Column:
    """Exactly ``length`` ids."""
    cut = F.slice(ids, 1, length)
    return F.concat(cut, F.array_repeat(F.lit(pad_id), F.greatest(F.lit(0), length - F.size(cut))))


def dot(a: Column, b: Column) -> Column:
    """Sum of products in double precision."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, v: s + v)


def decode_tokens(encoded: DataFrame, vocabulary: DataFrame, key: str, special_ids: tuple[int, ...] = ()) -> DataFrame:
    """``key, text``: the tokens of ``ids``, without special ones, joined by spaces.

    Every row has a text: ids that are null, empty, all special or not in the vocabulary
    give the empty string, and rows of the same key stay apart.
    """
    rows = encoded.select(key, "ids", F.monotonically_increasing_id().alias("_row"))
    flat = rows.select(key, "_row", F.posexplode_outer("ids").alias("pos", "token_id"))
    plain = F.when(~F.col("token_id").isin(*special_ids), F.col("token_id")) if special_ids else F.col("token_id")
    named = flat.withColumn("token_id", plain).join(vocabulary.select("token_id", "token"), "token_id", "left")
    parts = F.array_sort(F.collect_list(F.when(F.col("token").isNotNull(), F.struct("pos", "token"))))
    joined = F.array_join(F.transform(parts, lambda x: x["token"]), " ")
    return named.groupBy("_row", key).agg(joined.alias("text")).select(key, "text")


def mean_vector(vectors: DataFrame, column: str) -> DataFrame:
    """``pos, mean`` of every component; partial sums leave each task, not vectors."""
    return vectors.select(F.posexplode(column).alias("pos", "x")).groupBy("pos").agg(F.avg(F.col("x").cast("double")).alias("mean"))


def with_new_vectors(vectors: DataFrame, new_ids: DataFrame, key: str, column: str) -> DataFrame:
    """``vectors`` and one row for each new id, filled with the mean of all."""
    ordered = F.array_sort(F.collect_list(F.struct("pos", "mean")))
    mean = mean_vector(vectors, column).agg(F.transform(ordered, lambda x: x["mean"]).alias(column))
    filled = new_ids.select(key).join(mean, F.lit(True))  # one row on the right
    return vectors.select(key, F.col(column).cast("array<double>").alias(column)).unionByName(filled)
