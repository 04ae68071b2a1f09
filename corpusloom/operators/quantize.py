"""Product quantisation and codebook codes.

A vector is cut into ``m`` equal slices; each slice is replaced by the number
of its nearest codebook entry. Codebooks are a table
``(part int, code bigint, center array<double>)``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.operators.batches import (
    BROADCAST_BYTES,
    bounded_blocks,
    map_batches,
    to_lists,
    to_matrix,
)
from corpusloom.operators.nearest import (
    SLICE_BYTES,
    TILE_DOCS,
    TILE_PAIRS,
    Candidates,
    _first_k,
    assign_nearest,
    best_in_block,
    dealt,
    likeness,
    probe_cells,
    raise_tops,
    scan_topk,
    topk_merge,
)
from corpusloom.operators.split import sample_n
from corpusloom.storage import stage

MAX_CODES = 1 << 15  # a code is a signed 16-bit number


def _width(df: DataFrame, vector: str) -> int:
    return df.select(F.size(vector)).first()[0]


def residuals(df: DataFrame, centroids: DataFrame, keep: list[str], vector: str = "embedding",
              cell: str = "cell") -> DataFrame:
    """The vectors less the coarse centroid of their cell."""
    shared = df.sparkSession.sparkContext.broadcast(_coarse(centroids))
    columns = list(dict.fromkeys([*keep, cell]))

    def compute(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        coarse = shared.value
        matrix = to_matrix(batch.column(vector), coarse[1].shape[1])
        cells = batch.column(cell).to_numpy(zero_copy_only=False)
        return {"residual": to_lists(_residual(matrix, cells, coarse), pa.float64())}

    new = T.StructType([T.StructField("residual", T.ArrayType(T.DoubleType()))])
    return map_batches(df, columns, vector, new, compute).withColumnRenamed("residual", vector)


def _slice_sums(df: DataFrame, vector: str, books: list[np.ndarray]) -> list:
    """Per slice and entry the number and the sum of the slices nearest to it.

    Every task adds up its rows first and sends one row per entry.
    """
    shared = df.sparkSession.sparkContext.broadcast(books)
    step = books[0].shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        counts = [np.zeros(len(b)) for b in held]
        sums = [np.zeros_like(b) for b in held]
        for batch in batches:
            matrix = to_matrix(batch.column(vector), step * len(held))
            for p, centers in enumerate(held):
                part = matrix[:, p * step:(p + 1) * step]
                _, found, _ = best_in_block(part, centers, np.arange(len(centers)), 1, "l2")
                counts[p] += np.bincount(found, minlength=len(centers))
                np.add.at(sums[p], found, part)
        for p, (n, total) in enumerate(zip(counts, sums)):
            hit = np.flatnonzero(n)
            if len(hit):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(hit), p), pa.int32()), pa.array(hit, pa.int64()),
                     pa.array(n[hit]), to_lists(total[hit], pa.float64())],
                    names=["part", "code", "n", "total"])

    found = df.select(vector).mapInArrow(
        run, "part int, code bigint, n double, total array<double>")
    total = vector_to_array(Summarizer.sum(array_to_vector(F.col("total")))).alias("total")
    summed = found.groupBy("part", "code").agg(F.sum("n").alias("n"), total).collect()
    shared.destroy()
    return summed


def pq_fit(df: DataFrame, m: int = 16, nbits: int = 8, key: str = "doc_id",
           vector: str = "embedding", seed: int = 0, max_iter: int = 20) -> DataFrame:
    """Learn up to ``2**nbits`` codebook entries for each of ``m`` slices.

    All slices are clustered together, so one iteration reads the vectors once.
    It starts from the slices of rows drawn by the hash of ``key`` and ends when
    no centre moves. Only the codebooks, whose size is set by ``nbits`` and the
    width, reach the driver.
    """
    width = _width(df, vector)
    if width % m:
        raise ValueError(f"width {width} isn't a multiple of {m}")
    if nbits > 15:
        raise ValueError("a code has 15 bits at most")
    step, entries = width // m, 1 << nbits
    drawn = sample_n(df.select(key, vector), entries, key, seed).orderBy(key).toArrow()
    start = to_matrix(drawn.column(vector), width)
    books = [np.unique(start[:, p * step:(p + 1) * step], axis=0) for p in range(m)]
    for _ in range(max_iter):
        moved = 0.0
        for part, code, n, total in _slice_sums(df, vector, books):
            center = np.asarray(total) / n
            moved = max(moved, float(np.abs(center - books[part][code]).max()))
            books[part][code] = center
        if moved < 1e-9:
            break
    sizes = [len(b) for b in books]
    return df.sparkSession.createDataFrame(pa.table({
        "part": pa.array(np.repeat(np.arange(m), sizes), pa.int32()),
        "code": pa.array(np.concatenate([np.arange(n) for n in sizes])),
        "center": to_lists(np.concatenate(books), pa.float64())}))


Books = tuple[list[np.ndarray], list[np.ndarray]]  # per slice the codes and the centres


def _codebooks(table: DataFrame, max_bytes: int = BROADCAST_BYTES) -> Books:
    """The codebooks as arrays, after a check of their size."""
    parts, codes, width = table.agg(
        F.count_distinct("part"), F.count(F.lit(1)), F.max(F.size("center"))).first()
    if codes * width * 8 > max_bytes or codes > parts * MAX_CODES:
        raise ValueError("the codebooks are over the bound")
    rows = table.select("part", "code", "center").orderBy("part", "code").toArrow()
    owner = rows.column("part").to_numpy()
    numbers, centers = rows.column("code").to_numpy(), to_matrix(rows.column("center"))
    return ([numbers[owner == p] for p in range(parts)],
            [centers[owner == p] for p in range(parts)])


def encode(matrix: np.ndarray, books: Books) -> np.ndarray:
    coded = np.empty((len(matrix), len(books[0])), dtype=np.int16)
    for p, (numbers, centers) in enumerate(zip(*books)):
        step = centers.shape[1]
        _, found, _ = best_in_block(
            matrix[:, p * step:(p + 1) * step], centers, numbers, 1, "l2")
        coded[:, p] = numbers[found]
    return coded


def decode(coded: np.ndarray, books: Books) -> np.ndarray:
    """The vectors that codes stand for."""
    return np.concatenate([centers[at] for centers, at in zip(books[1], _positions(coded, books))], axis=1)


def _coarse(centroids: DataFrame | None) -> tuple[np.ndarray, np.ndarray] | None:
    if centroids is None:
        return None
    blocks = list(bounded_blocks(centroids, "centroid_id", "center"))
    if len(blocks) != 1:
        raise ValueError("the coarse centroids are over the bound")
    return blocks[0].ids, blocks[0].matrix


def _residual(matrix: np.ndarray, cells: np.ndarray, coarse) -> np.ndarray:
    ids, centers = coarse
    return matrix - centers[np.searchsorted(ids, cells)]


def pq_encode(df: DataFrame, codebooks: DataFrame, keep: list[str], vector: str = "embedding",
              centroids: DataFrame | None = None, cell: str = "cell", with_error: bool = False) -> DataFrame:
    """Append ``codes array<smallint>`` to ``keep``.

    With coarse ``centroids`` the difference to the centroid of the row's
    ``cell`` is encoded. ``with_error`` adds ``error double``, the distance of the vector to
    what its codes stand for.
    """
    context = df.sparkSession.sparkContext
    shared = context.broadcast((_codebooks(codebooks), _coarse(centroids)))
    columns = [*keep, cell] if centroids is not None and cell not in keep else keep

    def compute(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        books, coarse = shared.value
        matrix = to_matrix(batch.column(vector), sum(c.shape[1] for c in books[1]))
        if coarse is not None:
            matrix = _residual(matrix, batch.column(cell).to_numpy(zero_copy_only=False), coarse)
        coded = encode(matrix, books)
        made = {"codes": to_lists(coded, pa.int16())}
        if with_error:
            gap = matrix - decode(coded, books)
            made["error"] = pa.array(np.sqrt(np.einsum("ij,ij->i", gap, gap)))
        return made

    new = T.StructType([T.StructField("codes", T.ArrayType(T.ShortType())),
                        *([T.StructField("error", T.DoubleType())] if with_error else [])])
    return map_batches(df, columns, vector, new, compute)


def _tables(queries: np.ndarray, books: Books) -> list[np.ndarray]:
    """Per slice the squared distances of the queries to all entries."""
    out = []
    for p, centers in enumerate(books[1]):
        step = centers.shape[1]
        part = queries[:, p * step:(p + 1) * step]
        out.append(((part[:, None, :] - centers[None, :, :]) ** 2).sum(axis=2))
    return out


def _positions(coded: np.ndarray, books: Books) -> list[np.ndarray]:
    """Codes may carry any number; the tables are addressed by the place in the codebook."""
    return [np.searchsorted(numbers, coded[:, p]) for p, numbers in enumerate(books[0])]


def _code_scan(queries: np.ndarray, coded: np.ndarray, ids: np.ndarray, books: Books,
               k: int) -> Candidates:
    places = _positions(coded, books)
    found = []
    # Both the distances to all documents and the tables over all entries stay small.
    entries = max(centers.size for centers in books[1])
    step = max(1, (1 << 22) // max(1, len(ids), entries))
    for start in range(0, len(queries), step):
        part = queries[start:start + step]
        total = np.zeros((len(part), len(ids)))
        for table, where in zip(_tables(part, books), places):
            total += table[:, where]
        like = -np.sqrt(total).astype(np.float32)
        if k < len(ids):
            kth = np.partition(like, len(ids) - k, axis=1)[:, len(ids) - k]
            qi, di = np.nonzero(like >= kth[:, None])
        else:
            qi, di = (a.ravel() for a in np.indices(like.shape))
        found.append(_first_k(qi + start, di, like[qi, di], ids[di], k))
    return tuple(np.concatenate(c) for c in zip(*found))


def pq_search(
    codes: DataFrame,
    queries: DataFrame,
    codebooks: DataFrame,
    k: int = 5,
    doc_id: str = "doc_id",
    query_id: str = "query_id",
    vector: str = "embedding",
    centroids: DataFrame | None = None,
    nprobe: int = 3,
    cell: str = "cell",
    max_bytes: int = SLICE_BYTES,
) -> DataFrame:
    """The best ``k`` documents per query by the distance of the query to their codes.

    With coarse ``centroids``, documents carry ``cell`` and were encoded as
    differences to its centroid; only the ``nprobe`` nearest cells are searched.
    """
    shared = codes.sparkSession.sparkContext.broadcast((_codebooks(codebooks), _coarse(centroids)))

    def scorer(matrix: np.ndarray, number: int | None) -> Callable[[pa.Table, np.ndarray], Candidates]:
        books, coarse = shared.value
        wanted = matrix if coarse is None else _residual(matrix, np.full(len(matrix), number), coarse)

        def find(slice_: pa.Table, rows: np.ndarray) -> Candidates:
            coded = to_matrix(slice_.column("codes"), len(books[0])).astype(np.int64)
            return _code_scan(wanted, coded, slice_.column(doc_id).to_numpy(), books, k)
        return find

    if centroids is None:
        return scan_topk(codes, queries, scorer, ["codes"], doc_id, k, "l2", query_id, vector,
                         max_bytes=max_bytes)
    probes = probe_cells(queries, centroids, nprobe, query_id, vector, cell)
    return scan_topk(codes, probes, scorer, ["codes"], doc_id, k, "l2", query_id, vector, cell=cell,
                     max_bytes=max_bytes)


class BoundedSearch(NamedTuple):
    """Neighbours, and the pairs that the codes leave open (``query_id``, ``doc_id``, ``low``, ``high``).

    The pairs are found when they are asked for; the search itself meets them inside its tasks.
    """

    found: DataFrame
    candidates: DataFrame


def _cost_ends(queries: np.ndarray, shift: np.ndarray, decoded: np.ndarray, error: np.ndarray,
               metric: str) -> tuple[np.ndarray, np.ndarray]:
    """The least and greatest cost of each row for each query.

    The cost is the distance or the negated product. That of the codes is off by the row's
    error at most, times the query's norm for the product. ``shift`` is what the coarse centroid
    adds to the cost. The sum over the slices' distances is that to the decoded vector.
    """
    norm = np.sqrt(np.einsum("ij,ij->i", queries, queries))[:, None]
    product = queries @ decoded.T
    if metric == "l2":
        total = norm ** 2 + np.einsum("ij,ij->i", decoded, decoded)[None, :] - 2 * product
        cost, off = np.sqrt(np.maximum(total, 0)), np.broadcast_to(error[None, :], product.shape)
    else:
        cost, off = shift[:, None] - product, norm * error[None, :]
    # Rounding, also that of the float scores that decide in the end.
    off = off + 1e-6 * (np.abs(cost) + norm)
    return cost - off, cost + off


def _code_bounds(queries: np.ndarray, shift: np.ndarray, coded: np.ndarray, error: np.ndarray, books: Books,
                 k: int, metric: str) -> tuple[np.ndarray, ...]:
    """(query, row, low, high) of the rows whose lowest cost may be among the k least.

    A row stays if its low end is under the k-th least high end.
    """
    decoded = decode(coded, books)
    step = max(1, (1 << 22) // max(1, len(coded)))
    found = []
    for start in range(0, len(queries), step):
        part = queries[start:start + step]
        low, high = _cost_ends(part, shift[start:start + step], decoded, error, metric)
        kth = np.partition(high, k - 1, axis=1)[:, k - 1] if k <= len(coded) else np.full(len(part), np.inf)
        qi, di = np.nonzero(low <= kth[:, None])
        found.append((qi + start, di, low[qi, di], high[qi, di]))
    return tuple(np.concatenate(c) for c in zip(*found))


def _code_best(queries: np.ndarray, center: np.ndarray | None, coded: np.ndarray, error: np.ndarray,
               docs: np.ndarray, ids: np.ndarray, books: Books, k: int, metric: str) -> Candidates:
    """The best ``k`` rows of each query: codes leave few rows of a tile to be scored on ``docs``.

    A row is scored if its lowest cost isn't over the k-th least so far, ``t``. With the distance
    ``c`` to the codes and the error ``e`` that is c <= t + e, or c^2 - t^2 - 2te - e^2 <= 0,
    so one product of matrices with two columns more decides for a whole tile.
    """
    decoded = decode(coded, books)
    ends, shift = queries, np.zeros(len(queries))
    if center is not None and metric == "l2":
        ends = queries - center
    elif center is not None:
        shift = -(queries @ center)
    one, none = np.ones(len(coded)), np.zeros(len(coded))
    d_sq = np.einsum("ij,ij->i", decoded, decoded)
    shrink = 1 - 1e-6  # cost - 1e-6 * cost, the allowance for rounding
    reach = error / shrink
    right = np.column_stack([decoded, reach, d_sq - reach ** 2, one] if metric == "l2" else
                            [decoded, error, none, one])
    far, wide = d_sq.max(initial=0.0), (reach ** 2).max(initial=0.0)
    step = max(1, TILE_PAIRS // max(1, min(len(coded), TILE_DOCS)))
    found = []
    for start in range(0, len(queries), step):
        part, asked = ends[start:start + step], queries[start:start + step]
        own = np.einsum("ij,ij->i", part, part)
        norm, moved = np.sqrt(own), shift[start:start + step]
        tops, kth = np.full((len(part), k), -np.inf), np.full(len(part), np.inf)

        def decided() -> tuple[np.ndarray, np.ndarray]:
            """The queries' side of the product and what it may come to."""
            if metric == "l2":
                t = (np.maximum(kth, 0) + 1e-6 * norm) / shrink
                return (np.column_stack([-2 * part, -2 * t, np.ones(len(part)), own - t ** 2]),
                        1e-12 * (own + far + t ** 2 + wide))
            slack = 1e-6 * (norm * (1 + np.sqrt(far)) + np.abs(moved) + np.abs(kth))
            return np.column_stack([-part, -norm, np.zeros(len(part)), moved - kth]), slack

        met = []
        for a in range(0, len(coded), TILE_DOCS):
            tile = slice(a, a + TILE_DOCS)
            if np.isinf(kth).any():
                low, high = _cost_ends(part, moved, decoded[tile], error[tile], metric)
                first = np.partition(high, k - 1, axis=1)[:, k - 1] if k <= high.shape[1] else np.inf
                open_ = low <= np.minimum(kth, first)[:, None]
            else:
                left, most = decided()
                open_ = left @ right[tile].T <= most[:, None]
            qi, di = np.divmod(np.flatnonzero(open_), open_.shape[1])
            if not len(qi):
                continue
            di += a
            like = likeness(asked, docs, qi, di, metric)
            raise_tops(tops, qi, like)
            kth = -tops.min(axis=1)
            # One step of a float under the k-th best: those that tie with it in the end stay.
            within = like >= -kth[qi] - 1e-6 * np.abs(kth[qi])
            met.append((qi[within], di[within], like[within]))
        if not met:
            continue
        qi, di, like = (np.concatenate(c) for c in zip(*met))
        found.append(_first_k(qi + start, di, like.astype(np.float32), ids[di], k))
    if not found:
        return np.empty(0, int), np.empty(0, int), np.empty(0, np.float32)
    return tuple(np.concatenate(c) for c in zip(*found))


def pq_search_bounded(
    codes: DataFrame,
    docs: DataFrame,
    queries: DataFrame,
    codebooks: DataFrame,
    k: int = 5,
    metric: str = "l2",
    doc_id: str = "doc_id",
    query_id: str = "query_id",
    vector: str = "embedding",
    centroids: DataFrame | None = None,
    nprobe: int = 3,
    cell: str = "cell",
    max_bytes: int = SLICE_BYTES,
) -> BoundedSearch:
    """The best ``k`` documents per query, exactly, from codes with their errors and few whole vectors.

    ``codes`` comes from ``pq_encode(..., with_error=True)``. Every row's cost lies within its error
    of the cost of its codes. Rows whose low end is over the k-th least cost so far can't be among
    the best; the others are scored on the vectors in ``docs``. So no neighbour is lost,
    whatever the codebooks are; better ones leave fewer candidates. With coarse ``centroids``
    the same holds within the ``nprobe`` nearest cells.

    A row's vector goes with its codes to the tasks and is looked at there: candidates are a
    share of all pairs, so they never become rows. Rows without an id find and are nothing.
    """
    if metric not in ("l2", "inner_product"):
        raise ValueError("metric is 'l2' or 'inner_product'")
    shared = codes.sparkSession.sparkContext.broadcast((_codebooks(codebooks), _coarse(centroids)))
    asked = queries.select(query_id, vector) if centroids is None else probe_cells(
        queries, centroids, nprobe, query_id, vector, cell)
    keyed = None if centroids is None else cell

    def center_of(number: int | None) -> np.ndarray | None:
        coarse = shared.value[1]
        return None if coarse is None else coarse[1][np.searchsorted(coarse[0], number)]

    def scorer(matrix: np.ndarray, number: int | None) -> Callable[[pa.Table, np.ndarray], Candidates]:
        books = shared.value[0]

        def find(slice_: pa.Table, rows: np.ndarray) -> Candidates:
            coded = to_matrix(slice_.column("codes"), len(books[0])).astype(np.int64)
            return _code_best(
                matrix, center_of(number), coded, slice_.column("error").to_numpy(),
                to_matrix(slice_.column(vector), matrix.shape[1]), slice_.column(doc_id).to_numpy(), books, k, metric)
        return find

    # An id that comes several times counts as often as its codes, vectors and queries are paired.
    whole = codes.select(doc_id, "codes", "error", *([cell] if keyed else [])).join(
        docs.select(doc_id, vector), doc_id)
    asking = asked.join(queries.select(query_id), query_id)
    found = scan_topk(whole, asking, scorer, [vector, "codes", "error"], doc_id, k, metric, query_id, vector,
                      cell=keyed, max_bytes=max_bytes)
    return BoundedSearch(found, _left_open(codes, asked, shared, center_of, k, metric, doc_id, query_id, vector,
                                           keyed, max_bytes))


def _left_open(codes: DataFrame, asked: DataFrame, shared: Broadcast, center_of: Callable, k: int, metric: str,
               doc_id: str, query_id: str, vector: str, cell: str | None, max_bytes: int) -> DataFrame:
    """The pairs whose low end isn't over the query's k-th least high end."""
    left, right, named = dealt(codes, asked, [doc_id, "codes", "error"], [query_id, vector], "codes", vector,
                               cell, max_bytes)
    names = ["query_id", "doc_id", "low", "high"]

    def run(key: tuple, slice_: pa.Table, block: pa.Table) -> pa.Table:
        if not (slice_.num_rows and block.num_rows):
            return pa.table([pa.array([], x) for x in (pa.int64(), pa.int64(), pa.float64(), pa.float64())],
                            names=names)
        books, matrix = shared.value[0], to_matrix(block.column(vector))
        shift, center = np.zeros(len(matrix)), center_of(key[0].as_py() if cell else None)
        if center is not None and metric == "l2":
            matrix = matrix - center
        elif center is not None:
            shift = -(matrix @ center)
        coded = to_matrix(slice_.column("codes"), len(books[0])).astype(np.int64)
        qi, di, low, high = _code_bounds(matrix, shift, coded, slice_.column("error").to_numpy(), books, k, metric)
        return pa.table([pa.array(block.column(query_id).to_numpy()[qi], pa.int64()),
                         pa.array(slice_.column(doc_id).to_numpy()[di], pa.int64()), pa.array(low),
                         pa.array(high)], names=names)

    near = left.groupBy(*named).cogroup(right.groupBy(*named)).applyInArrow(
        run, "query_id bigint, doc_id bigint, low double, high double")
    kth = topk_merge(near, k, score="high", descending=False).where(F.col("rank") == k).select(
        "query_id", F.col("high").alias("_kth"))
    return near.join(kth, "query_id", "left").where(
        F.col("_kth").isNull() | (F.col("low") <= F.col("_kth"))).drop("_kth")


def reshape_codes(df: DataFrame, width: int = 1024, code: str = "code", batch: str = "batch",
                  position: str = "pos") -> DataFrame:
    """Rows of ``width`` codes from a flat sequence ``(batch, pos, code)``.

    A row gathers exactly ``width`` entries; a short or overfull one is an error.
    """
    row = F.floor(F.col(position) / width).cast("bigint").alias("row_in_batch")
    gathered = df.groupBy(batch, row).agg(
        F.sort_array(F.collect_list(F.struct(position, code))).alias("_c"))
    return gathered.select(
        batch, "row_in_batch",
        F.when(F.size("_c") == width, F.col(f"_c.{code}").cast("array<smallint>"))
        .otherwise(F.raise_error(F.lit(f"a row of codes isn't {width} wide"))).alias("codes"))


def codebook_codes(patches: DataFrame, codebook: DataFrame, width: int, image: str = "image_id",
                   position: str = "pos", vector: str = "embedding") -> DataFrame:
    """Per image the nearest codebook entries of its patches, in patch order.

    An image with fewer or more than ``width`` patches is an error.
    """
    coded = assign_nearest(patches, codebook, [image, position], vector)
    entry = F.struct(position, F.col("centroid_id").cast("smallint").alias("code"))
    gathered = coded.groupBy(image).agg(F.sort_array(F.collect_list(entry)).alias("_c"))
    message = F.concat(F.lit(f"not {width} patches in image "), F.col(image).cast("string"))
    return gathered.select(image, F.when(F.size("_c") == width, F.col("_c.code")).otherwise(
        F.raise_error(message)).alias("codes"))
