"""From raw captions to a diverse, clustered subset of vectors."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text
from corpusloom.operators.cluster import Clustering, cluster_two_level
from corpusloom.operators.dedup import dedup_head_tail
from corpusloom.operators.numbering import chunk_fixed
from corpusloom.operators.take import take_vectors


@dataclass(frozen=True)
class CaptionRules:
    """Which cleaning steps apply, in this order."""

    strip: bool = True
    min_words: int = 5
    drop_null_like: bool = True
    plain_charset: bool = False


def clean_captions(captions: DataFrame, rules: CaptionRules = CaptionRules()) -> DataFrame:
    c = F.col("caption")
    if rules.strip:
        captions = captions.withColumn("caption", text.strip_blank(c))
    if rules.min_words:
        captions = captions.where(text.has_min_words(c, rules.min_words))
    if rules.drop_null_like:
        captions = captions.where(~text.is_null_like(c))
    if rules.plain_charset:
        captions = captions.where(text.is_plain_charset(c))
    return captions


def diverse_vectors(
    captions: DataFrame,
    vectors: DataFrame,
    rules: CaptionRules = CaptionRules(),
    scope: str = "global",
    chunk_rows: int = 100_000,
    strict: bool = True,
) -> DataFrame:
    """The vectors of clean captions with distinct beginnings and ends, in chunks per shard.

    A caption without a vector is an error, or left out if not ``strict``.
    """
    kept = dedup_head_tail(clean_captions(captions, rules), scope=scope)
    return chunk_fixed(take_vectors(kept, vectors, strict=strict), chunk_rows)


def cluster_corpus(vectors: DataFrame, k_first: int = 10_000, k_final: int = 50_000,
                   seed: int = 0) -> Clustering:
    return cluster_two_level(vectors, k_first, k_final, seed=seed)
