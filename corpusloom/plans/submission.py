"""From the captions of several models to one pooled vector per image, in long form."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import clean_caption, strip_filler
from corpusloom.operators.embed import Encoder, HashingEncoder, embed_text
from corpusloom.operators.ensemble import attach_suffix, mean_pool, submission_long


def caption_submission(
    captions: DataFrame,
    suffixes: DataFrame,
    make_encoder: Callable[[], Encoder] = HashingEncoder,
    anchored: bool = False,
) -> DataFrame:
    """``imgId_eId, val``.

    ``captions`` holds ``image_id, model, seq, text``, ``suffixes`` holds
    ``image_id, suffix``. Captions are cleaned, given the suffix of their image,
    stripped of filler words, embedded and averaged per image.
    """
    cleaned = captions.withColumn("text", clean_caption(F.col("text")))
    prompts = attach_suffix(cleaned, suffixes).withColumn(
        "text", strip_filler(F.col("text"), anchored))
    embedded = embed_text(prompts, ["image_id"], make_encoder, "text")
    return submission_long(mean_pool(embedded, ["image_id"]))
