"""From vector shards to shorter vectors: fit on the first rows, check on the rest, apply."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.operators import reduce
from corpusloom.operators.split import split_contiguous
from corpusloom.storage import stage

POSITION = ["shard", "row_index"]


@dataclass(frozen=True)
class Reduction:
    reduced: DataFrame
    rejected: DataFrame
    model: reduce.Autoencoder
    validation_error: float


def reduce_corpus(vectors: DataFrame, input_dim: int = 1024, output_dim: int = 256,
                  train_ratio: float = 0.9, method: str = "pca", **options) -> Reduction:
    """Reduce every vector of the right width; the others come back as ``rejected``."""
    usable, rejected = reduce.split_by_width(vectors, input_dim)
    marked = stage(split_contiguous(usable.select(*POSITION, "embedding"), train_ratio, POSITION))
    train, validation = marked.where("is_train"), marked.where(~F.col("is_train"))
    model = reduce.fit_reducer(train, validation, input_dim, output_dim, "row_index", method,
                               **options)
    error = reduce.reconstruction_mse(validation, model, POSITION).first()[0]
    reduced = reduce.encode_mlp(usable, model.encoder, POSITION)
    return Reduction(reduced, rejected, model, error)
