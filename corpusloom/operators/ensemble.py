"""Tags, suffixes, pooling and the long output of a caption ensemble."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.paths import long_key
from corpusloom.functions.text import tag_suffix
from corpusloom.functions.vectors import as_double
from corpusloom.operators.nearest import nearest_targets
from corpusloom.operators.numbering import number_rows

# How many labels of each category a prompt takes.
TAGS_PER_CATEGORY = {"medium": 1, "movement": 1, "flavor": 3}


def select_tags(images: DataFrame, keywords: DataFrame, image: str = "image_id",
                vector: str = "embedding", quotas: dict[str, int] | None = None,
                other: int = 1) -> DataFrame:
    """The labels nearest to each image by cosine, per category, best first.

    ``quotas`` says how many labels a category gives, ``other`` how many one that it
    doesn't name. Gives ``image, category, rank, label_id, label, score``. A category
    has few labels, so they go to every task and the images stay in place.
    """
    wanted = TAGS_PER_CATEGORY if quotas is None else quotas
    most = max(other, *wanted.values()) if wanted else other
    near = nearest_targets(images, keywords, most, [image], "cosine", "label_id", vector, vector,
                           category="category")
    quota = F.lit(other)
    for category, count in wanted.items():
        quota = F.when(F.col("category") == category, count).otherwise(quota)
    entry = F.posexplode(F.arrays_zip("target_ids", "target_scores")).alias("pos", "e")
    ranked = near.select(image, "category", entry).where(F.col("pos") < quota).select(
        image, "category", (F.col("pos") + 1).alias("rank"),
        F.col("e.target_ids").alias("label_id"), F.col("e.target_scores").alias("score"))
    names = keywords.select("category", "label_id", "label")
    return ranked.join(names, ["category", "label_id"]).select(
        image, "category", "rank", "label_id", "label", "score")


def suffixes(tags: DataFrame, image: str = "image_id") -> DataFrame:
    """One suffix per image. An image has a handful of tags, so the lists are short.

    A category without a tag leaves its place in the suffix empty.
    """

    def labels(category: str) -> Column:
        entry = F.when(F.col("category") == category, F.struct("rank", "label"))
        return F.transform(F.sort_array(F.collect_list(entry)), lambda e: e["label"])

    gathered = tags.groupBy(image).agg(
        labels("medium").alias("m"), labels("movement").alias("v"), labels("flavor").alias("f"))
    medium, movement = (F.coalesce(F.get(c, F.lit(0)), F.lit("")) for c in ("m", "v"))
    return gathered.select(image, tag_suffix(medium, movement, F.col("f")).alias("suffix"))


def attach_suffix(prompts: DataFrame, suffix: DataFrame, mode: str = "image",
                  image: str = "image_id", order_by: Sequence[str] = ("image_id", "seq"),
                  text: str = "text", model: str = "model") -> DataFrame:
    """Append the suffix to each prompt.

    ``'image'`` joins by image; a prompt whose image has no suffix is an error.
    ``'tiled'`` gives prompt ``j`` of its model's prompts in the order ``order_by`` the
    suffix of image ``j mod n`` of n images.
    """
    if mode == "image":
        joined = prompts.join(suffix, image, "left")
        missing = F.raise_error(F.concat(F.lit("no suffix for image "), F.col(image).cast("string")))
        ending = F.coalesce("suffix", missing)
    elif mode == "tiled":
        n = suffix.count()
        if n == 0:
            raise ValueError("no suffixes")
        numbered = number_rows(prompts, [model, *order_by], "_j", within=[model]).withColumn(
            "_slot", F.col("_j") % n)
        slots = number_rows(suffix, [image], "_slot").select("_slot", "suffix")
        joined, ending = numbered.join(slots, "_slot"), F.col("suffix")
    else:
        raise ValueError("mode is 'image' or 'tiled'")
    return joined.withColumn(text, F.concat(text, ending)).select(*prompts.columns)


def union_models(frames: dict[str, DataFrame], name: str = "model") -> DataFrame:
    """The rows of all models, each marked with its model."""
    marked = [f.withColumn(name, F.lit(m)) for m, f in frames.items()]
    return reduce(lambda a, b: a.unionByName(b), marked)


def mean_pool(df: DataFrame, by: Sequence[str], vector: str = "embedding",
              name: str = "pooled") -> DataFrame:
    """The element-wise mean per group; partial sums are made before the shuffle."""
    mean = Summarizer.mean(array_to_vector(as_double(F.col(vector))))
    return df.groupBy(*by).agg(vector_to_array(mean).alias(name))


def weighted_mean(df: DataFrame, value: str, weight: str, by: Sequence[str] = (),
                  name: str = "weighted_mean") -> DataFrame:
    """``sum(value * weight) / sum(weight)``."""
    total = F.sum(F.col(value) * F.col(weight)) / F.sum(weight)
    return df.groupBy(*by).agg(total.alias(name))


def submission_long(df: DataFrame, image: str = "image_id", vector: str = "pooled") -> DataFrame:
    """One row per image and element: ``imgId_eId, val``."""
    return df.select(image, F.posexplode(vector).alias("e", "val")).select(
        long_key(F.col(image), F.col("e")).alias("imgId_eId"), F.col("val").cast("double"))
