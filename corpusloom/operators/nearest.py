"""Nearest-neighbour search: exact, pruned by cells, and nearest centroids.

Queries and documents meet as blocks: documents are dealt to slices and queries to blocks of
bounded bytes and rows, both by hash, and every task works on one slice and one block at a time (of one
cell, where the search is pruned). Neither side passes through the driver, and no pair of query
and document becomes a row unless it is among the best k of its slice. A slice is sent once
for each block of queries and a block once for each slice; a vector in a slice meets thousands of
queries there, so arithmetic outweighs the bytes moved. One shuffle by query merges the best k.

Scores are computed in double and reported as float. Rows rank by the float
score, then by the lower document id, so the order doesn't depend on how the
data was partitioned.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from corpusloom.functions.vectors import NORM_FLOOR, cosine, dot, l2_distance
from corpusloom.operators.batches import (
    BLOCK_BYTES,
    BROADCAST_BYTES,
    Block,
    bounded_block,
    bounded_blocks,
    over_blocks,
    to_lists,
    to_matrix,
)
from corpusloom.storage import stage

METRICS = ("inner_product", "cosine", "l2")
Candidates = tuple[np.ndarray, np.ndarray, np.ndarray]  # query index, row index, likeness


def _check_metric(metric: str) -> None:
    if metric not in METRICS:
        raise ValueError(f"metric is one of {METRICS}")


def _unit(m: np.ndarray) -> np.ndarray:
    return m / np.maximum(np.sqrt(np.einsum("ij,ij->i", m, m)), NORM_FLOOR)[:, None]


def _first_k(q: np.ndarray, d: np.ndarray, like: np.ndarray, ids: np.ndarray, k: int) -> Candidates:
    """The best ``k`` candidates of each query; likeness descending, then id."""
    order = np.lexsort((ids, -like, q))
    q, d, like = q[order], d[order], like[order]
    starts = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.empty(0, int)
    sizes = np.diff(np.r_[starts, len(q)])
    keep = np.arange(len(q)) - np.repeat(starts, sizes) < k
    return q[keep], d[keep], like[keep]


#: Documents, and pairs, of one matrix product: it stays in a core's cache.
TILE_DOCS, TILE_PAIRS = 1024, 1 << 18


def raise_tops(tops: np.ndarray, rows: np.ndarray, values: np.ndarray) -> None:
    """Take further ``values`` of some ``rows`` into the greatest so far of each (rows x k)."""
    order = np.lexsort((-values, rows))
    rows, values = rows[order], values[order]
    hit, starts, sizes = np.unique(rows, return_index=True, return_counts=True)
    place = np.arange(len(rows)) - np.repeat(starts, sizes)
    at, few = np.repeat(np.arange(len(hit)), sizes), place < tops.shape[1]
    fresh = np.full((len(hit), tops.shape[1]), -np.inf)
    fresh[at[few], place[few]] = values[few]
    tops[hit] = np.partition(np.concatenate([tops[hit], fresh], axis=1), tops.shape[1], axis=1)[:, tops.shape[1]:]


def likeness(queries: np.ndarray, docs: np.ndarray, qi: np.ndarray, di: np.ndarray, metric: str) -> np.ndarray:
    """The likeness of each pair, one by one in double; unit vectors are given for the cosine."""
    like = np.empty(len(qi))
    pairs = max(1, BLOCK_BYTES // (24 * max(1, docs.shape[1])))
    for a in range(0, len(qi), pairs):
        x, y = queries[qi[a:a + pairs]], docs[di[a:a + pairs]]
        if metric == "l2":
            gap = x - y
            like[a:a + pairs] = -np.sqrt(np.einsum("ij,ij->i", gap, gap))
        else:
            like[a:a + pairs] = np.einsum("ij,ij->i", x, y)
    return like


def best_in_block(queries: np.ndarray, docs: np.ndarray, ids: np.ndarray, k: int,
                  metric: str) -> Candidates:
    """The best ``k`` of ``docs`` for each of ``queries``.

    Matrix products of a tile of queries and one of documents after another find all rows within
    rounding error of the k-th best so far; those still within that of the k-th best of all
    are scored again pair by pair, so ties come out right. A tile after the first costs little
    more than its product: few of its documents reach the k-th best.
    """
    if metric == "cosine":
        queries, docs = _unit(queries), _unit(docs)
    q_sq = np.einsum("ij,ij->i", queries, queries)
    d_sq = np.einsum("ij,ij->i", docs, docs)
    top_sq = d_sq.max(initial=0.0)
    right = docs if metric != "l2" else np.column_stack([docs, -d_sq, np.ones(len(docs))])
    found = []
    step = max(1, TILE_PAIRS // max(1, min(len(docs), TILE_DOCS)))
    for start in range(0, len(queries), step):
        part, own = queries[start:start + step], q_sq[start:start + step]
        left = part if metric != "l2" else np.column_stack([2 * part, np.ones(len(part)), -own])
        scale = own + top_sq if metric == "l2" else np.sqrt(own * top_sq)
        tops, floor = np.full((len(part), k), -np.inf), np.full(len(part), -np.inf)
        met = []
        for a in range(0, len(docs), TILE_DOCS):
            near = left @ right[a:a + TILE_DOCS].T
            first = a == 0 and k <= near.shape[1]
            if first:
                tops = np.partition(near, near.shape[1] - k, axis=1)[:, near.shape[1] - k:]
                kth = tops.min(axis=1)
                floor = kth - (3e-7 * np.abs(kth) + 1e-12 * scale)
            qi, di = np.divmod(np.flatnonzero(near >= floor[:, None]), near.shape[1])
            if not len(qi):
                continue
            values = near[qi, di]
            if not first:
                raise_tops(tops, qi, values)
                kth = tops.min(axis=1)
                floor = kth - (3e-7 * np.abs(kth) + 1e-12 * scale)
            met.append((qi, di + a, values))
        if not met:
            continue
        qi, di, values = (np.concatenate(c) for c in zip(*met))
        within = values >= floor[qi]
        qi, di = qi[within], di[within]
        like = likeness(part, docs, qi, di, metric).astype(np.float32)
        found.append(_first_k(qi + start, di, like, ids[di], k))
    if not found:
        return np.empty(0, int), np.empty(0, int), np.empty(0, np.float32)
    return tuple(np.concatenate(c) for c in zip(*found))


def _rank(df: DataFrame, k: int, by: Sequence[str], descending: bool, item: str,
          score: str) -> DataFrame:
    best = F.col(score).desc() if descending else F.col(score).asc()
    window = Window.partitionBy(*by).orderBy(best, F.col(item).asc())
    return df.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= k)


def topk_merge(df: DataFrame, k: int, query: str = "query_id", item: str = "doc_id",
               score: str = "score", descending: bool = True,
               group: Sequence[str] = ()) -> DataFrame:
    """The best ``k`` rows per query; Spark cuts to k in each task before the shuffle."""
    return _rank(df, k, [*group, query], descending, item, score)


#: Bytes of vectors, as doubles, and rows on each side of a comparison: a task's memory and time.
SLICE_BYTES, PIECE_ROWS = 32 * 1024 * 1024, 1 << 16
#: Documents that are worth a slice of their own while cores would be idle.
SLICE_ROWS = 256
#: Tasks beyond which every comparison has one on average: several in a task even out by then.
MANY_TASKS = 4096
#: Pairs that are worth a task of their own.
TASK_PAIRS = 1 << 22
_SLICE, _BLOCK = "_slice", "_block"


def _width(df: DataFrame, column: str) -> int:
    first = df.select(F.size(column)).first()
    return max(1, (first[0] if first else None) or 1)


def dealt(docs: DataFrame, queries: DataFrame, doc_columns: Sequence[str], query_columns: Sequence[str],
          doc_vector: str, query_vector: str, cell: str | None = None,
          max_bytes: int = SLICE_BYTES) -> tuple[DataFrame, DataFrame, list[str]]:
    """Both sides with the numbers of slice and block, and the columns that name a comparison.

    Rows of each side per slice or block follow from counts and widths. With ``cell`` every
    cell is cut on its own, so a cell of any size spreads; cells without queries are
    left out (and not read, where ``cell`` is a partition column).

    A comparison takes time by its pairs, not by its bytes, by which Spark would put several in
    one task: both sides are dealt to a set number of tasks, four for each comparison unless
    those are tiny.
    """
    wide = {"d": _width(docs, doc_vector) * 8, "q": _width(queries, query_vector) * 8}
    context = docs.sparkSession.sparkContext
    if cell is None:
        n_docs, n_queries = docs.count(), queries.count()
        slices = max(1, -(-n_docs * wide["d"] // max_bytes), -(-n_docs // PIECE_ROWS),
                     min(context.defaultParallelism, -(-n_docs // SLICE_ROWS)))
        blocks = max(1, -(-n_queries * wide["q"] // max_bytes), -(-n_queries // PIECE_ROWS))
        pieces, pairs = slices * blocks, n_docs * n_queries
        left = docs.select(*doc_columns, F.lit(slices).alias("_s"), F.lit(blocks).alias("_b"))
        right = queries.select(*query_columns, F.lit(slices).alias("_s"), F.lit(blocks).alias("_b"))
        named = [_SLICE, _BLOCK]
    else:
        def counted(df: DataFrame, name: str) -> DataFrame:
            rows = F.count(F.lit(1))
            return df.groupBy(cell).agg(rows.alias(f"{name}_rows"), F.greatest(
                F.ceil(rows * wide[name[-1]] / F.lit(max_bytes)), F.ceil(rows / F.lit(PIECE_ROWS))).cast("int").alias(name))

        # One row for each cell: written, so that its true size decides how it is joined.
        counts = stage(counted(queries, "_q").join(counted(docs, "_d"), cell).select(
            F.col(cell), F.col("_d").alias("_s"), F.col("_q").alias("_b"),
            (F.col("_q_rows").cast("double") * F.col("_d_rows")).alias("_pairs"))).where(F.col(cell) >= 0)
        pieces, pairs = (int(x or 1) for x in counts.agg(
            F.sum(F.col("_s").cast("bigint") * F.col("_b")), F.sum("_pairs")).first())
        cut = counts.drop("_pairs")
        left = docs.select(cell, *doc_columns).join(cut, cell)
        right = queries.select(cell, *query_columns).join(cut, cell)
        named = [cell, _SLICE, _BLOCK]
    keys = [cell] if cell else []

    def each(n: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    left = left.select(*keys, *doc_columns, F.pmod(F.xxhash64(*doc_columns), F.col("_s")).cast("int").alias(
        _SLICE), each("_b").alias(_BLOCK))
    right = right.select(*keys, *query_columns, F.pmod(F.xxhash64(*query_columns), F.col("_b")).cast(
        "int").alias(_BLOCK), each("_s").alias(_SLICE))
    tasks = min(4 * pieces, max(pieces, MANY_TASKS), max(context.defaultParallelism, -(-4 * pairs // TASK_PAIRS)))
    return left.repartition(tasks, *named), right.repartition(tasks, *named), named


def scan_topk(
    docs: DataFrame,
    queries: DataFrame,
    scorer: Callable[[np.ndarray, int | None], Callable[[pa.Table, np.ndarray], Candidates]],
    columns: Sequence[str],
    doc_id: str,
    k: int,
    metric: str,
    query_id: str = "query_id",
    vector: str = "embedding",
    group: str | None = None,
    cell: str | None = None,
    max_bytes: int = SLICE_BYTES,
) -> DataFrame:
    """The best ``k`` documents of every query (per ``group``), compared block by block.

    ``scorer(matrix, cell)`` of a block of queries gives a function of a slice and the row
    numbers in it to search, which returns at most k candidates per query. The first of
    ``columns`` is the one whose width counts.
    """
    sign = np.float32(-1.0 if metric == "l2" else 1.0)
    fields = [T.StructField("query_id", T.LongType()), T.StructField("doc_id", T.LongType()),
              T.StructField("score", T.FloatType())]
    if group:
        fields.insert(0, docs.schema[group])
    names = [f.name for f in fields]
    left, right, named = dealt(
        docs, queries, list(dict.fromkeys([doc_id, *columns, *([group] if group else [])])),
        [query_id, vector], columns[0], vector, cell, max_bytes)

    def run(key: tuple, slice_: pa.Table, block: pa.Table) -> pa.Table:
        found = []
        if slice_.num_rows and block.num_rows:
            asking = block.column(query_id).to_numpy()
            find = scorer(to_matrix(block.column(vector)), key[0].as_py() if cell else None)
            ids = slice_.column(doc_id).to_numpy()
            parts = [(None, np.arange(slice_.num_rows))]
            if group:
                coded = slice_.column(group).combine_chunks().dictionary_encode()
                codes = coded.indices.to_numpy(zero_copy_only=False)
                parts = [(g, np.flatnonzero(codes == i)) for i, g in enumerate(coded.dictionary)]
            for name, rows in parts:
                qi, ri, like = find(slice_, rows)
                made = [pa.array(asking[qi], pa.int64()), pa.array(ids[ri], pa.int64()),
                        pa.array(sign * like, pa.float32())]
                if group:
                    made.insert(0, pa.repeat(name, len(qi)))
                found.append(pa.Table.from_arrays(made, names=names))
        if not found:
            kinds = [pa.int64(), pa.int64(), pa.float32()]
            if group:
                kinds.insert(0, slice_.schema.field(group).type if slice_.num_columns else pa.null())
            return pa.table([pa.array([], x) for x in kinds], names=names)
        return pa.concat_tables(found)

    made = left.groupBy(*named).cogroup(right.groupBy(*named)).applyInArrow(run, T.StructType(fields))
    return topk_merge(made, k, descending=metric != "l2", group=[group] if group else [])


def knn_exact(
    docs: DataFrame,
    queries: DataFrame,
    k: int = 5,
    metric: str = "inner_product",
    doc_id: str = "doc_id",
    query_id: str = "query_id",
    vector: str = "embedding",
    group: str | None = None,
    negate_query: bool = False,
    max_bytes: int = SLICE_BYTES,
) -> DataFrame:
    """The best ``k`` documents per query: ``query_id, doc_id, score, rank``.

    With ``group``, the best k per query in each group of documents.
    ``negate_query`` turns the query round, which under the inner product
    finds the least similar.
    """
    _check_metric(metric)
    return scan_topk(docs, queries, _exact(doc_id, vector, k, metric, negate_query), [vector], doc_id, k,
                     metric, query_id, vector, group, max_bytes=max_bytes)


def _exact(doc_id: str, vector: str, k: int, metric: str, negate: bool = False):
    """The scorer of whole vectors."""
    def scorer(matrix: np.ndarray, cell: int | None):
        wanted = -matrix if negate else matrix

        def find(slice_: pa.Table, rows: np.ndarray) -> Candidates:
            some = slice_ if len(rows) == slice_.num_rows else slice_.take(pa.array(rows))
            docs = to_matrix(some.column(vector), wanted.shape[1])
            qi, di, like = best_in_block(wanted, docs, some.column(doc_id).to_numpy(), k, metric)
            return qi, rows[di], like

        return find

    return scorer


_GATHERED = "_gathered"


@dataclass(frozen=True)
class GroupedCenters:
    """Centres gathered under coarse points, so that far groups can be left out.

    ``order`` lists the centres group by group, ``starts`` the edges of the groups in it;
    ``radius`` is the largest distance of a group's centre to its coarse point.
    """

    coarse: np.ndarray
    radius: np.ndarray
    order: np.ndarray
    starts: np.ndarray

    @classmethod
    def of(cls, centers: np.ndarray, steps: int = 3) -> GroupedCenters:
        """About as many groups as the root of the number of centres, after a few full steps."""
        groups = max(1, int(round(len(centers) ** 0.5)))
        coarse = centers[np.linspace(0, len(centers) - 1, groups).astype(int)].copy()

        def owners() -> np.ndarray:
            return best_in_block(centers, coarse, np.arange(groups), 1, "l2")[1]

        for _ in range(steps):
            owner = owners()
            count = np.bincount(owner, minlength=groups)
            total = np.zeros_like(coarse)
            np.add.at(total, owner, centers)
            coarse[count > 0] = total[count > 0] / count[count > 0, None]
        owner = owners()
        gap = centers - coarse[owner]
        radius = np.zeros(groups)
        np.maximum.at(radius, owner, np.sqrt(np.einsum("ij,ij->i", gap, gap)))
        order = np.argsort(owner, kind="stable")
        return cls(coarse, radius, order, np.searchsorted(owner[order], np.arange(groups + 1)))

    def nearest(self, x: np.ndarray, centers: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """The nearest centre of each row (the lower id on a tie), its likeness, and the distances computed.

        A centre is no nearer than its coarse point less the radius of the group (the triangle
        inequality). Each row visits its likeliest group first and then only those whose bound
        doesn't exceed the best distance found.
        """
        reach, slack = best_likeness(x, self.coarse, self.radius, np.full(len(self.coarse), np.inf), "l2")
        bound = -(reach + slack)
        best = np.full(len(x), -1)
        like = np.full(len(x), -np.inf, np.float32)
        computed = x.shape[0] * len(self.coarse)
        first = bound.argmin(axis=1)
        for own in (True, False):
            for g in range(len(self.coarse)):
                members = self.order[self.starts[g]:self.starts[g + 1]]
                rows = np.flatnonzero(first == g if own else (first != g) & (bound[:, g] <= -like.astype(np.float64)))
                if len(members) == 0 or len(rows) == 0:
                    continue
                computed += len(rows) * len(members)
                _, at, found = best_in_block(x[rows], centers[members], ids[members], 1, "l2")
                at = members[at]
                better = (found > like[rows]) | ((found == like[rows]) & (ids[at] < ids[best[rows]]))
                better |= best[rows] < 0
                best[rows[better]], like[rows[better]] = at[better], found[better]
        return best, like, computed


def nearest_targets(
    df: DataFrame,
    targets: DataFrame,
    k: int,
    keep: Sequence[str],
    metric: str = "l2",
    target_id: str = "centroid_id",
    target_vector: str = "center",
    vector: str = "embedding",
    category: str | None = None,
    max_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """The best ``k`` targets of every row, best first.

    For many rows against a moderate set, such as centroids: adds
    ``target_ids array<bigint>`` and ``target_scores array<float>`` to
    ``keep`` without a shuffle. With ``category`` (a column of the targets)
    there is one row per category. ``keep`` must identify a row. Targets over
    ``max_bytes`` are taken in blocks and the best of all blocks merged.
    """
    _check_metric(metric)
    extra = [category] if category else []
    new = T.StructType([T.StructField("target_ids", T.ArrayType(T.LongType())),
                        T.StructField("target_scores", T.ArrayType(T.FloatType()))])
    if category:
        new = T.StructType([targets.schema[category], *new.fields])
    sign = np.float32(-1.0 if metric == "l2" else 1.0)
    source = df.select(*dict.fromkeys([*keep, vector]))
    schema = T.StructType([source.schema[c] for c in keep] + list(new.fields))
    names = [f.name for f in schema.fields]
    named = to_arrow_type(targets.schema[category].dataType) if category else None

    def assign(shared: Broadcast) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = Block(*shared.value)
            labels = np.array(held.extra[category]) if category else np.zeros(len(held.ids))
            groups = [(g, np.flatnonzero(labels == g)) for g in np.unique(labels)]
            gathered = [GroupedCenters(*parts) for parts in held.extra.get(_GATHERED, [])]
            for batch in batches:
                if batch.num_rows == 0:
                    continue
                matrix = to_matrix(batch.column(vector), held.matrix.shape[1])
                for place, (name, members) in enumerate(groups):
                    ids = held.ids[members]
                    if gathered:
                        ti, like, _ = gathered[place].nearest(matrix, held.matrix[members], ids)
                    else:
                        _, ti, like = best_in_block(matrix, held.matrix[members], ids, k, metric)
                    width = min(k, len(members))
                    offsets = np.arange(batch.num_rows + 1, dtype=np.int32) * width
                    columns = [batch.column(c) for c in keep]
                    if category:
                        columns.append(pa.array([name.item()] * batch.num_rows, named))
                    columns.append(pa.ListArray.from_arrays(offsets, pa.array(ids[ti], pa.int64())))
                    columns.append(pa.ListArray.from_arrays(
                        offsets, pa.array(sign * like, pa.float32())))
                    yield pa.RecordBatch.from_arrays(columns, names=names)

        return source.mapInArrow(run, schema)

    def gathered(block: Block) -> Block:
        """The block with its targets under coarse points, found once and sent along."""
        labels = np.array(block.extra[category]) if category else np.zeros(len(block.ids))
        found = [GroupedCenters.of(block.matrix[labels == g]) for g in np.unique(labels)]
        return Block(block.ids, block.matrix, {**block.extra, _GATHERED: [
            (c.coarse, c.radius, c.order, c.starts) for c in found]})

    blocks = bounded_blocks(targets, target_id, target_vector, extra, max_bytes)
    if k == 1 and metric == "l2":
        # One nearest target: far groups of targets are skipped, with the same result.
        blocks = map(gathered, blocks)
    pieces = over_blocks(df.sparkSession, blocks, assign)
    if not pieces:
        return df.sparkSession.createDataFrame([], schema)
    if len(pieces) == 1:
        return pieces[0]
    # k entries per block and row: the list of one row is bounded by k times the blocks.
    by = [*keep, *extra]
    entries = reduce(DataFrame.unionByName, pieces).select(
        *by, F.explode(F.arrays_zip("target_ids", "target_scores")).alias("_e"))
    place = F.col("_e.target_scores") * F.lit(-1.0 if metric != "l2" else 1.0)
    entry = F.struct(place.alias("o"), F.col("_e.target_ids").alias("id"),
                     F.col("_e.target_scores").alias("s"))
    ordered = entries.groupBy(*by).agg(
        F.slice(F.sort_array(F.collect_list(entry)), 1, k).alias("_b"))
    return ordered.select(*by, F.col("_b.id").alias("target_ids"),
                          F.col("_b.s").alias("target_scores"))


def assign_nearest(df: DataFrame, centroids: DataFrame, keep: Sequence[str],
                   vector: str = "embedding", centroid_id: str = "centroid_id",
                   center: str = "center", max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """The Euclidean nearest centroid of each row, the lower id on a tie."""
    found = nearest_targets(df, centroids, 1, keep, "l2", centroid_id, center, vector,
                            max_bytes=max_bytes)
    return found.select(*keep, F.get("target_ids", F.lit(0)).alias("centroid_id"),
                        F.get("target_scores", F.lit(0)).alias("distance"))


def assign_cells(docs: DataFrame, centroids: DataFrame, vector: str = "embedding",
                 name: str = "cell", max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Append the number of the nearest coarse centroid to each document.

    Write the result with ``partitionBy(cell)`` and ``knn_ivf`` reads the
    probed cells only.
    """
    near = nearest_targets(docs, centroids, 1, docs.columns, "l2", vector=vector, max_bytes=max_bytes)
    return near.select(*docs.columns, F.get("target_ids", F.lit(0)).alias(name))


def store_cells(docs: DataFrame, centroids: DataFrame, vector: str = "embedding",
                name: str = "cell") -> DataFrame:
    """Documents with their cell, written in one folder per cell.

    A search over the result reads the folders of probed cells only. Small cells are
    gathered in few files, and a cell of any size spreads over several.
    """
    assigned = assign_cells(docs, centroids, vector, name)
    return stage(assigned.hint("rebalance", name), [name])


def probe_cells(queries: DataFrame, centroids: DataFrame, nprobe: int, query_id: str,
                vector: str, cell: str = "cell") -> DataFrame:
    """A row for each query and one of its ``nprobe`` nearest cells; staged, as it is read twice."""
    near = nearest_targets(queries, centroids, nprobe, [query_id, vector], "l2", vector=vector)
    return stage(near.select(query_id, vector, F.explode("target_ids").alias(cell)))


def knn_ivf(
    docs: DataFrame,
    queries: DataFrame,
    centroids: DataFrame,
    k: int = 5,
    nprobe: int = 3,
    metric: str = "inner_product",
    doc_id: str = "doc_id",
    query_id: str = "query_id",
    vector: str = "embedding",
    cell: str = "cell",
    max_bytes: int = SLICE_BYTES,
) -> DataFrame:
    """The best ``k`` documents per query among those in its ``nprobe`` nearest cells.

    ``docs`` carries the column ``cell`` from ``assign_cells``. A query with
    fewer than k documents in its cells gets fewer rows.
    """
    _check_metric(metric)
    probes = probe_cells(queries, centroids, nprobe, query_id, vector, cell)
    return scan_topk(docs, probes, _exact(doc_id, vector, k, metric), [vector], doc_id, k, metric,
                     query_id, vector, cell=cell, max_bytes=max_bytes)


class PrunedSearch(NamedTuple):
    """Neighbours, and the cells that were read for each query (``query_id``, ``cell``)."""

    found: DataFrame
    read: DataFrame


def cell_bounds(docs: DataFrame, centroids: DataFrame, metric: str = "inner_product",
                vector: str = "embedding", cell: str = "cell") -> DataFrame:
    """``centroid_id, center``, rows, radius and largest norm of each cell with documents.

    The radius is the largest distance of a document to the centroid (of the unit vectors
    of both for ``cosine``). Every task sends one row for each cell it met.
    """
    _check_metric(metric)
    block = bounded_block(centroids, "centroid_id", "center")
    shared = docs.sparkSession.sparkContext.broadcast(block.parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, centers, _ = shared.value
        centers = _unit(centers) if metric == "cosine" else centers
        rows, far, norm = np.zeros(len(ids), np.int64), np.zeros(len(ids)), np.zeros(len(ids))
        for batch in batches:
            if batch.num_rows == 0:
                continue
            matrix = to_matrix(batch.column(vector), centers.shape[1])
            matrix = _unit(matrix) if metric == "cosine" else matrix
            at = np.searchsorted(ids, batch.column(cell).to_numpy(zero_copy_only=False))
            gap = matrix - centers[at]
            rows += np.bincount(at, minlength=len(ids))
            np.maximum.at(far, at, np.sqrt(np.einsum("ij,ij->i", gap, gap)))
            np.maximum.at(norm, at, np.sqrt(np.einsum("ij,ij->i", matrix, matrix)))
        met = np.flatnonzero(rows)
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids[met], pa.int64()), pa.array(rows[met]), pa.array(far[met]), pa.array(norm[met])],
            names=["centroid_id", "rows", "radius", "norm"])

    parts = docs.select(cell, vector).mapInArrow(
        run, "centroid_id bigint, rows bigint, radius double, norm double")
    return parts.groupBy("centroid_id").agg(
        F.sum("rows").alias("rows"), F.max("radius").alias("radius"), F.max("norm").alias("norm")).join(
        centroids.select("centroid_id", "center"), "centroid_id")


def best_likeness(queries: np.ndarray, centers: np.ndarray, radius: np.ndarray, norm: np.ndarray,
                  metric: str) -> tuple[np.ndarray, np.ndarray]:
    """What the best document of each cell can reach at most (queries x cells), and the rounding slack.

    By the triangle inequality a document is no nearer than the centroid less the radius;
    by that of Cauchy and Schwarz its product exceeds the centroid's by the query's norm times the
    radius at most, and is no greater than the product of the norms.
    """
    if metric == "cosine":
        queries, centers = _unit(queries), _unit(centers)
    own = np.sqrt(np.einsum("ij,ij->i", queries, queries))[:, None]
    far = np.sqrt(np.einsum("ij,ij->i", centers, centers))[None, :]
    product = queries @ centers.T
    if metric == "l2":
        gap = np.sqrt(np.maximum(own ** 2 + far ** 2 - 2 * product, 0))
        # The square root of a small difference of large squares is off by more.
        return -np.maximum(gap - radius[None, :], 0), 1e-6 * (own + far + radius[None, :])
    return (np.minimum(product + own * radius[None, :], own * norm[None, :]),
            1e-6 * own * (far + radius[None, :]))


def knn_pruned(
    docs: DataFrame,
    queries: DataFrame,
    centroids: DataFrame,
    k: int = 5,
    metric: str = "inner_product",
    doc_id: str = "doc_id",
    query_id: str = "query_id",
    vector: str = "embedding",
    cell: str = "cell",
    first: int = 1,
    max_bytes: int = SLICE_BYTES,
    bounds: DataFrame | None = None,
) -> PrunedSearch:
    """The best ``k`` documents per query, the same as ``knn_exact``, from as few cells as its bounds allow.

    Each query takes its cells in the order of what their best document can reach, ``first``
    of them in the first round and twice as many in each further one, and stops at the cell
    that can't beat its k-th best so far. ``docs`` carries ``cell`` from ``assign_cells``
    or ``store_cells``; ``query_id`` must be unique. ``bounds`` are those of ``cell_bounds`` if they are
    known already, which saves a scan of all documents.
    """
    _check_metric(metric)
    spark = docs.sparkSession
    known = stage(cell_bounds(docs, centroids, metric, vector, cell)) if bounds is None else bounds
    block = bounded_block(known, "centroid_id", "center", ["radius", "norm"])
    shared = spark.sparkContext.broadcast(block.parts)
    asked = stage(queries.select(F.col(query_id).alias("query_id"), F.col(vector).alias("_v")))
    schema = T.StructType([T.StructField("query_id", T.LongType()),
                           T.StructField("_v", T.ArrayType(T.DoubleType())), T.StructField(cell, T.LongType())])
    turn = -1.0 if metric == "l2" else 1.0

    def probes(state: DataFrame, low: int, high: int) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, centers, extra = shared.value
            radius, norm = np.array(extra["radius"]), np.array(extra["norm"])
            for batch in batches:
                if batch.num_rows == 0:
                    continue
                matrix = to_matrix(batch.column("_v"), centers.shape[1])
                kth = batch.column("_kth").to_numpy(zero_copy_only=False).astype(np.float64)
                names = batch.column("query_id").to_numpy(zero_copy_only=False)
                step = max(1, BLOCK_BYTES // (8 * len(ids)))
                for a in range(0, len(matrix), step):
                    part = matrix[a:a + step]
                    reach, slack = best_likeness(part, centers, radius, norm, metric)
                    order = np.argsort(-reach, axis=1, kind="stable")[:, low:high]
                    can = np.take_along_axis(reach + slack, order, 1)
                    beaten = can < turn * kth[a:a + step, None]  # never with fewer than k so far
                    qi, at = np.nonzero(~beaten)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(names[a:a + step][qi], pa.int64()), to_lists(part[qi], pa.float64()),
                         pa.array(ids[order[qi, at]], pa.int64())], names=schema.names)

        return stage(state.select("query_id", "_v", "_kth").mapInArrow(run, schema))

    cells, low, high = len(block.ids), 0, first
    state = asked.withColumn("_kth", F.lit(None).cast("float"))
    best, read = None, []
    while low < cells:
        probed = probes(state, low, high)
        if probed.isEmpty():
            break
        read.append(probed.select("query_id", cell))
        found = scan_topk(docs, probed, _exact(doc_id, vector, k, metric), [vector], doc_id, k,
                          metric, "query_id", "_v", cell=cell, max_bytes=max_bytes)
        if best is not None:
            found = topk_merge(best.drop("rank").unionByName(found.drop("rank")), k, descending=metric != "l2")
        best = stage(found)
        kth = best.where(F.col("rank") == k).select("query_id", F.col("score").alias("_kth"))
        state = asked.join(kth, "query_id", "left")
        low, high = high, high + 2 * (high - low)
    if best is None:
        empty = "query_id bigint, doc_id bigint, score float, rank int"
        return PrunedSearch(spark.createDataFrame([], empty),
                            spark.createDataFrame([], f"query_id bigint, {cell} bigint"))
    return PrunedSearch(best, reduce(DataFrame.unionByName, read))


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """The share of the exact neighbours that a pruned search found."""
    hits = exact.select("query_id", "doc_id").join(
        found.select("query_id", "doc_id", F.lit(1).alias("_hit")), ["query_id", "doc_id"], "left")
    return hits.agg((F.count("_hit") / F.count(F.lit(1))).alias("recall"))


def recall_by_nprobe(
    docs: DataFrame,
    sample: DataFrame,
    centroids: DataFrame,
    k: int = 5,
    metric: str = "inner_product",
    doc_id: str = "doc_id",
    query_id: str = "query_id",
    vector: str = "embedding",
    cell: str = "cell",
) -> list[float]:
    """The recall of ``knn_ivf`` against brute force with 1, 2, ... all cells probed.

    A pruned search finds exactly those of the exact neighbours whose cell it probes, so
    one exact search over the sampled queries gives the recall of every ``nprobe``.
    """
    exact = knn_exact(docs, sample, k, metric, doc_id, query_id, vector)
    cells = centroids.count()
    near = nearest_targets(sample, centroids, cells, [query_id], "l2", vector=vector).select(
        F.col(query_id).alias("query_id"), "target_ids")
    placed = exact.select("query_id", "doc_id").join(
        docs.select(F.col(doc_id).alias("doc_id"), cell), "doc_id").join(near, "query_id")
    counts = dict(placed.groupBy(
        F.array_position("target_ids", F.col(cell)).cast("int").alias("place")).count().collect())
    found = np.cumsum([counts.get(n, 0) for n in range(1, cells + 1)])
    return [float(n) / max(1, sum(counts.values())) for n in found]


def nprobe_for_recall(docs: DataFrame, sample: DataFrame, centroids: DataFrame, k: int = 5,
                      target: float = 0.9, **options) -> int:
    """The fewest cells to probe for a recall of ``target`` on the sampled queries."""
    shares = recall_by_nprobe(docs, sample, centroids, k, **options)
    return next((n for n, share in enumerate(shares, 1) if share >= target), len(shares))


def rerank(
    found: DataFrame,
    docs: DataFrame,
    queries: DataFrame,
    k: int = 5,
    metric: str = "inner_product",
    doc_id: str = "doc_id",
    query_id: str = "query_id",
    vector: str = "embedding",
) -> DataFrame:
    """The best ``k`` of a longer list of candidates, such as that of ``pq_search``, by exact score."""
    _check_metric(metric)
    score = {"inner_product": dot, "cosine": cosine, "l2": l2_distance}[metric]
    pairs = found.select("query_id", "doc_id").join(
        docs.select(F.col(doc_id).alias("doc_id"), F.col(vector).alias("_d")), "doc_id").join(
        queries.select(F.col(query_id).alias("query_id"), F.col(vector).alias("_q")), "query_id")
    scored = pairs.select("query_id", "doc_id", score(F.col("_q"), F.col("_d")).cast("float").alias("score"))
    return topk_merge(scored, k, descending=metric != "l2")
