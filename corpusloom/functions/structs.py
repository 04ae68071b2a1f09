"""Nested records to flat columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def flatten_struct(df: DataFrame, sep: str = ".") -> DataFrame:
    """Every leaf of the nested structs as a column named by its path."""

    def leaves(kind: T.StructType, path: tuple[str, ...]):
        for field in kind.fields:
            here = (*path, field.name)
            if isinstance(field.dataType, T.StructType):
                yield from leaves(field.dataType, here)
            else:
                yield here

    quoted = {p: ".".join(f"`{x}`" for x in p) for p in leaves(df.schema, ())}
    return df.select(*[F.col(q).alias(sep.join(p)) for p, q in quoted.items()])
