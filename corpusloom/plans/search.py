"""From an image index and code vectors to the neighbours of query images."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.cluster import fit_cells
from corpusloom.operators.nearest import knn_exact, knn_ivf, store_cells
from corpusloom.operators.take import neighbour_meta


def search_images(
    docs: DataFrame,
    queries: DataFrame,
    index: DataFrame,
    k: int = 5,
    nlist: int = 8,
    nprobe: int = 3,
    metric: str = "inner_product",
    exact: bool = False,
    strict: bool = True,
    fit_steps: int = 10,
) -> DataFrame:
    """The best ``k`` images per query with their index rows.

    ``docs`` holds ``doc_id, embedding`` with the image number as id, ``queries``
    ``query_id, embedding``. Without ``exact`` only the ``nprobe`` nearest of
    ``nlist`` cells are searched; one set of cells serves all documents.
    A document without an index row is an error; without ``strict`` its columns are null.
    """
    if exact:
        found = knn_exact(docs, queries, k, metric)
    else:
        cells = fit_cells(docs, nlist, max_iter=fit_steps)
        found = knn_ivf(store_cells(docs, cells), queries, cells, k, nprobe, metric)
    named = neighbour_meta(found, index, strict=strict)
    return named.select("query_id", F.col("rank").cast("bigint").alias("rank"), "doc_id", "score",
                        *[c for c in index.columns if c != "image_number"])
