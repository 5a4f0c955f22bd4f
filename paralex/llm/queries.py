"""The registered queries of this subpackage, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paralex.llm import bpe, centroids, langid, media, neighbours, packing, prefixes, quality, repeats, ring, simhash, sstable, urls
from paralex.llm.common import table


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and bytes of every whole text, as digests.

    A null or empty text has no ids and no bytes; repeated rows repeat; an empty table gives no rows; other columns are not read.
    """
    return bpe.round_trip_digests(table(spark, sf_dir, "documents"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document with its sequence and offset.

    A null or empty text is the end id alone; repeated rows are packed each, ties of length in order of task; an empty table gives no rows.
    """
    return packing.pack_documents(table(spark, sf_dir, "documents"), with_ids=False)


def op3_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest rows of each fiftieth vector.

    Null, zero and non-finite vectors take no part; ties go to the smaller id; repeated vectors are all candidates; an empty table gives no rows.
    """
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document, by the law ``rows``.

    A null text has size 1; null and repeated ids are salted, with slots of their own; an empty table gives no rows.
    """
    return ring.shard_documents(table(spark, sf_dir, "documents"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document.

    Null and empty texts have fingerprint zero; a component of null ids alone has a null id; repeated rows repeat; an empty table gives no rows.
    """
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score and verdict of every document.

    Texts without words score the learned share of good ones; without labels the score is 0.5; repeated rows repeat; an empty table gives no rows.
    """
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language and score of every document.

    Null texts and those without letters are ``und``; repeated rows repeat; an empty table gives no rows.
    """
    return langid.identify(table(spark, sf_dir, "documents"))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the token files of all documents hold, read back from them.

    A null or empty text is the end id alone; a null id sorts first; repeated ids are ordered by a hash of their text; an empty table gives no rows.
    """
    return sstable.read_shards(spark, sstable.write_shards(table(spark, sf_dir, "documents")))


def op9_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every page's URL.

    A null URL, or one without ``://``, has an empty host and path; repeated rows repeat; an empty table gives no rows.
    """
    return urls.judge(table(spark, sf_dir, "pages"))


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every whole text stored as an image and read back.

    A null or empty text is one row of bytes 255; equal texts give equal values; an empty table gives no rows.
    """
    return media.features(media.store(table(spark, sf_dir, "documents")))


def op11_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every whole text without the 200-byte strings that occur again.

    A null text is empty; shorter texts stay whole; repeated rows are copies and lose all of 200 bytes and more; an empty table gives no rows.
    """
    return repeats.without_repeats(table(spark, sf_dir, "documents"), bodies=False).drop("spans")


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the prefix trie of all rebuilt conversations.

    Null roles and texts are empty, null turns come first, rows without conv_id take no part; repeated rows are repeated turns; an empty table gives no rows.
    """
    return prefixes.trie(table(spark, sf_dir, "conversations"))


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster, distance and inertia of every vector after ten rounds.

    Vectors that are null, of another length or not finite take no part; repeated rows count each; ties go to the smaller centroid; an empty table gives no rows.
    """
    return centroids.cluster(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (
        op1_byte_bpe, op2_packing, op3_neighbours, op4_sharding, op5_simhash, op6_quality, op7_language, op8_token_files, op9_urls, op10_media,
        op11_suffix_repeats, op12_prefix_trie, op13_centroids,
    )
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    """None: every query has a column that SQL can't say (ids, models, rings, images)."""
    return {}


def column_sql() -> dict[str, str]:
    """DuckDB SQL of the columns that it can say of some queries; ``tests/llm`` compares these."""
    host = "CASE WHEN contains(coalesce(url, ''), '://') THEN translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END"
    path = "CASE WHEN contains(coalesce(url, ''), '://') THEN regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) ELSE '' END"
    fits = " ".join(
        f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{h}{p}'" for _, h, p in sorted(urls.RULES, key=lambda r: -len(r[1] + r[2]))
    )
    blob = "encode(coalesce(text, ''))"
    size = f"octet_length({blob})"
    full = f"greatest(1, CAST(ceil({size} / 576.0) AS BIGINT)) * 576"
    return {
        "op1_byte_bpe": f"SELECT doc_id, sha256({blob}) AS decoded_sha256 FROM documents",
        "op4_sharding": f"SELECT doc_id, {size} + 1 AS size, 'rows' AS law FROM documents",
        "op9_urls": f"SELECT page_id, host, path, CASE {fits} END AS rule FROM (SELECT page_id, {host} AS host, {path} AS path FROM pages)",
        "op10_media": f"SELECT doc_id, {size} AS n_bytes, {full} AS payload_bytes, "
        f"sha256({blob} || repeat('\\xFF'::BLOB, {full} - {size})) AS payload_sha256 FROM documents",
    }
