"""A vector index that stays: built once, reopened by later sessions, extended by further vectors.

A folder holds the coarse centroids, codebooks if asked for, and one part for each call that
added vectors. A part has its vectors and codes in a folder for each cell, and the radius and
largest norm of its cells, so a search reads the folders of the cells it probes and never scans
all vectors for bounds. A part counts once its line in ``parts`` is written, which comes last:
what a lost driver left half written is neither read nor in the way of the next call, which
writes the same part anew. One writer at a time; readers keep the parts they opened.

Edge cases: an index without parts finds nothing; null ids or vectors, vectors of another width
and ids that the index or the call itself holds already are errors; further columns aren't kept.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.vectors import as_double
from corpusloom.operators import quantize
from corpusloom.operators.cluster import fit_cells
from corpusloom.operators.nearest import assign_cells, cell_bounds, knn_ivf, knn_pruned
from corpusloom.storage import exists, stage

_VECTORS = "doc_id long, embedding array<double>, part int, cell long"
_CODES = "doc_id long, codes array<smallint>, error double, part int, cell long"
_BOUNDS = "centroid_id long, rows long, radius double, norm double, unit boolean, part int"
_CENTROIDS = "centroid_id long, center array<double>"
_BOOKS = "part int, code long, center array<double>"
_PARTS = "rows long, width int, part int"


@dataclass(frozen=True)
class VectorIndex:
    """An opened index: the parts that were whole at that time, with their rows."""

    spark: SparkSession
    folder: str
    parts: dict[int, int]

    def _read(self, name: str, schema: str) -> DataFrame:
        paths = [f"{self.folder}/{name}/part={n}" for n in sorted(self.parts)]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", f"{self.folder}/{name}").parquet(*paths)

    @property
    def vectors(self) -> DataFrame:
        return self._read("vectors", _VECTORS)

    @property
    def codes(self) -> DataFrame:
        return self._read("codes", _CODES)

    @property
    def centroids(self) -> DataFrame:
        return self.spark.read.schema(_CENTROIDS).parquet(f"{self.folder}/centroids")

    @property
    def codebooks(self) -> DataFrame | None:
        path = f"{self.folder}/codebooks"
        return self.spark.read.schema(_BOOKS).parquet(path) if exists(self.spark, path) else None

    def bounds(self, metric: str) -> DataFrame:
        """What ``cell_bounds`` gives for all vectors, from the figures of the parts."""
        own = self._read("bounds", _BOUNDS).where(F.col("unit") == F.lit(metric == "cosine"))
        return own.groupBy("centroid_id").agg(
            F.sum("rows").alias("rows"), F.max("radius").alias("radius"), F.max("norm").alias("norm")).join(
            self.centroids, "centroid_id")

    def search(self, queries: DataFrame, k: int = 5, metric: str = "inner_product",
               nprobe: int | None = None) -> DataFrame:
        """The best ``k`` vectors for each ``query_id, embedding``: ``query_id, doc_id, score, rank``.

        Exact, from as few cells as the bounds allow; with ``nprobe`` from the nearest cells only.
        """
        if nprobe is not None:
            return knn_ivf(self.vectors, queries, self.centroids, k, nprobe, metric)
        return knn_pruned(self.vectors, queries, self.centroids, k, metric, bounds=self.bounds(metric)).found

    def search_codes(self, queries: DataFrame, k: int = 5, metric: str = "l2", nprobe: int = 3) -> DataFrame:
        """The best ``k`` of the ``nprobe`` nearest cells: codes leave few vectors to be scored."""
        books = self.codebooks
        if books is None:
            raise ValueError(f"{self.folder} was built without codes")
        return quantize.pq_search_bounded(self.codes, self.vectors, queries, books, k, metric,
                                          centroids=self.centroids, nprobe=nprobe).found

    def check(self) -> None:
        """An error if the files of a part don't hold the rows that its line says."""
        for name, schema in [("vectors", _VECTORS), *([("codes", _CODES)] if self.codebooks else [])]:
            held = {r[0]: r[1] for r in self._read(name, schema).groupBy("part").count().collect()}
            for part, rows in self.parts.items():
                if held.get(part, 0) != rows:
                    raise ValueError(f"part {part} has {held.get(part, 0)} rows of {name}, not {rows}")

    def add(self, docs: DataFrame, doc_id: str = "doc_id", vector: str = "embedding") -> VectorIndex:
        """The index with further vectors as a new part; cells and codebooks stay."""
        width = self.centroids.select(F.size("center")).first()[0]
        fits = F.col(doc_id).isNotNull() & F.coalesce(F.size(vector) == width, F.lit(False)) & ~F.exists(
            F.coalesce(vector, F.array()), lambda x: x.isNull())
        sound = F.when(fits, as_double(F.col(vector))).otherwise(F.raise_error(
            F.lit(f"an id is null or a vector isn't {width} numbers wide")))
        new = docs.select(F.col(doc_id).cast("long").alias("doc_id"), sound.alias("embedding"))
        part = max(self.parts, default=-1) + 1
        books, centers = self.codebooks, self.centroids

        def written(df: DataFrame, name: str, by_cell: bool) -> None:
            writer = (df.hint("rebalance", "cell") if by_cell else df).write.mode("overwrite")
            (writer.partitionBy("cell") if by_cell else writer).parquet(f"{self.folder}/{name}/part={part}")

        written(assign_cells(new, centers), "vectors", True)
        own = VectorIndex(self.spark, self.folder, {part: 0})
        ids = own.vectors.select("doc_id")
        twice = ids.groupBy("doc_id").count().where("count > 1").select("doc_id")
        again = twice.unionByName(ids.join(self.vectors.select("doc_id"), "doc_id", "left_semi")).take(1)
        if again:
            raise ValueError(f"id {again[0][0]} is in the index already or comes twice")
        if books is not None:
            written(quantize.pq_encode(own.vectors, books, ["doc_id", "cell"], centroids=centers,
                                       with_error=True), "codes", True)
        figures = [cell_bounds(own.vectors, centers, metric).select(
            "centroid_id", "rows", "radius", "norm", F.lit(metric == "cosine").alias("unit"))
            for metric in ("l2", "cosine")]
        written(figures[0].unionByName(figures[1]), "bounds", False)
        rows = own.vectors.count()
        written(self.spark.createDataFrame([(rows, width)], "rows long, width int").coalesce(1), "parts", False)
        return VectorIndex(self.spark, self.folder, {**self.parts, part: rows})


def build_index(docs: DataFrame, folder: str, nlist: int = 8, codes: dict[str, int] | None = None,
                doc_id: str = "doc_id", vector: str = "embedding", fit_steps: int = 10) -> VectorIndex:
    """Fit ``nlist`` cells on ``docs``, write them to ``folder``, and add ``docs`` as the first part.

    ``codes`` (``m``, ``nbits``, ``max_iter`` of ``pq_fit``) asks for codebooks of the
    differences to the centroids. A folder that holds an index already is an error.
    """
    spark, folder = docs.sparkSession, folder.rstrip("/")
    if exists(spark, f"{folder}/parts"):
        raise ValueError(f"{folder} holds an index already")
    named = docs.select(F.col(doc_id).cast("long").alias("doc_id"), as_double(F.col(vector)).alias("embedding"))
    fit_cells(named, nlist, max_iter=fit_steps).select("centroid_id", "center").write.mode(
        "overwrite").parquet(f"{folder}/centroids")
    index = VectorIndex(spark, folder, {})
    if codes is not None:
        rest = quantize.residuals(stage(assign_cells(named, index.centroids)), index.centroids, ["doc_id"])
        quantize.pq_fit(rest, **codes).write.mode("overwrite").parquet(f"{folder}/codebooks")
    return index.add(named)


def open_index(spark: SparkSession, folder: str) -> VectorIndex:
    """The index in ``folder`` with the parts that are whole."""
    folder = folder.rstrip("/")
    if not exists(spark, f"{folder}/centroids"):
        raise ValueError(f"there is no index in {folder}")
    if not exists(spark, f"{folder}/parts"):
        return VectorIndex(spark, folder, {})
    lines = spark.read.schema(_PARTS).parquet(f"{folder}/parts").select("part", "rows").collect()
    return VectorIndex(spark, folder, {r["part"]: r["rows"] for r in lines})
