"""From an image index to training and validation lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.paths import image_path
from corpusloom.operators.split import train_val_split


def training_lists(index: DataFrame, root: str, val_size: int, train_size: int, key: str,
                   seed: int = 0, **options) -> DataFrame:
    """``part_of, path, prompt`` of both sets."""
    sets = train_val_split(index, val_size, train_size, key, seed=seed, **options)

    def listed(name: str, rows: DataFrame) -> DataFrame:
        path = image_path(root, F.col("part"), F.col("img_name"))
        return rows.select(F.lit(name).alias("part_of"), path.alias("path"), "prompt")

    return listed("train", sets.train).unionByName(listed("validation", sets.validation))
