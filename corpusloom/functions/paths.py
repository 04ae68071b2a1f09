"""Building and parsing paths and identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def image_path(root: str, part: Column, img_name: Column) -> Column:
    return F.concat_ws("/", F.lit(root.rstrip("/")), part, img_name)


def png_path(directory: str, image_id: Column) -> Column:
    return F.concat(F.lit(directory.rstrip("/") + "/"), image_id.cast("string"), F.lit(".png"))


def file_id(filename: Column, prefix: str = "metadata_", suffix: str = ".parquet") -> Column:
    """The shard number in a metadata file name."""
    bare = F.replace(filename, F.lit(prefix), F.lit(""))
    return F.replace(bare, F.lit(suffix), F.lit(""))


def part_number(path: Column) -> Column:
    """The text after the last ``_`` before the first ``.``."""
    return F.substring_index(F.substring_index(path, ".", 1), "_", -1)


def stem(filename: Column) -> Column:
    """The text before the first ``.``."""
    return F.substring_index(filename, ".", 1)


def image_of_key(key: Column) -> Column:
    """The image id of a long key ``{image}_{element}``."""
    return F.substring_index(key, "_", 1)


def moved_path(path: Column, old_root: str, new_root: str, old_stem: str, new_stem: str) -> Column:
    """An output path that mirrors an input path under another root and file stem."""
    rooted = F.replace(path, F.lit(old_root), F.lit(new_root))
    return F.replace(rooted, F.lit(old_stem), F.lit(new_stem))


def long_key(image_id: Column, element: Column) -> Column:
    return F.concat_ws("_", image_id.cast("string"), element.cast("string"))
