"""Removal of repeated byte strings by distributed prefix doubling.

A byte goes if a string of ``threshold`` bytes that covers it also starts earlier: in a
document with a smaller id, or earlier in the same one. Ranks name strings: positions
with equal ranks start equal strings. A rank of twice the length is the rank of a pair,
(rank at p, rank at p + offset). Sorting the pairs, finding equal neighbours and going
on with those alone is prefix doubling; it ends where a rank is unique or the length
reaches the threshold.

* Up to half the threshold ranks are doubled inside each task over whole arrays
  (``prefix_ranks``); no sort could drop a position that early.
* Round 1 sorts only sampled positions: of each ``threshold``-byte window the position of
  the smallest half-length rank (every copy of the window samples the same one). A rank
  that stands at one position only ends there, with all windows sampled to it. Neighbouring
  windows with the same sample form a stretch of up to 150 bytes, whose rank is made of the
  ranks at its start, at the growing offset and at its end. Of equal stretches all but the
  first are repeats, whole.
* Round 2 sorts the windows of first stretches whose sample has other stretches too, by the
  rank of the pair (rank at p, rank at p + half): the pair covers the threshold, so equal
  neighbours are repeats.

Each task finds the first of equal stretches or windows in 4 MB of text before rows are
shuffled; those that repeat it are settled and dealt by place, so a passage in a third of
all documents sends its rank one row for 4 MB. A rank with many different stretches is dealt
out stretch by stretch. No round looks at pairs of documents. Ranks are 64-bit fingerprints:
two different strings share one with a chance of 2^-64.

Edge cases: null text is empty; texts shorter than the threshold keep all bytes; a null
``doc_id`` comes before all others; rows with equal id and text are one document seen
several times and all get its result; rows with equal id and different texts follow each
other in the order of a 64-bit hash of text and length; an empty table gives an empty result. Ids are
integers. Further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm.registry import query, table
from corpusloom.llm.textgrams import U, pair, prefix_ranks, ranges, slices, text_bytes, window_min
from corpusloom.storage import release, stage

THRESHOLD = 100
#: Bytes of text whose ranks a task holds at once (about 20 arrays of 8 bytes each).
CHUNK = 1 << 18
#: Bytes of text whose stretches are compared before they are sent (48 bytes for each).
COMBINED = 1 << 22

#: Stretches of one rank in so much text beyond which they are dealt one by one.
HOT = 16

_POS = 24  # bits of a place inside a chunk
_NULL_ID = -(1 << 63)


def _keys(docs: DataFrame, doc_id: str, text: str, keep: Sequence[str]) -> DataFrame:
    raw = F.coalesce(F.col(text), F.lit(""))
    return docs.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)], F.coalesce(F.col(doc_id).cast("long"), F.lit(_NULL_ID)).alias("_d"),
                       F.xxhash64(raw, F.octet_length(raw)).alias("_t"), raw.cast("binary").alias("_x"))


def _sampled(data: np.ndarray, begin: int, end: int, threshold: int):
    """Stretches of the windows that start in ``begin .. end - 1`` of ``data``.

    Gives window starts ``first`` .. ``last`` of each stretch, the rank of its sample and
    of itself, and the distance of the sample from the first window.
    """
    half = threshold // 2
    ranks = prefix_ranks(data[begin:end + threshold - 1], half)
    mask = U((1 << _POS) - 1)
    placed = (ranks & ~mask) | np.arange(len(ranks), dtype=U)
    least = (window_min(placed, threshold - half + 1) & mask).astype(np.int64)
    return ranks, least


def _first_of(keys: list[np.ndarray], order: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Rows that come first among those with equal keys, and rows that repeat such a one.

    A row at the very place of the first (the same document seen again) is neither.
    """
    if len(keys[0]) == 0:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    rows = np.lexsort([*order[::-1], *keys[::-1]])
    new = np.ones(len(rows), bool)
    new[1:] = np.any([k[rows[1:]] != k[rows[:-1]] for k in keys], axis=0)
    head = rows[np.maximum.accumulate(np.where(new, np.arange(len(rows)), 0))]
    same = np.all([o[rows] == o[head] for o in order], axis=0)
    return rows[new], rows[~new & ~same]


#: place is first * threshold + number of further windows: one number sorts and holds both.
_ROUND_1 = T.StructType([
    T.StructField("rank", T.LongType()), T.StructField("stretch", T.LongType()),
    T.StructField("_d", T.LongType()), T.StructField("_t", T.LongType()),
    T.StructField("place", T.LongType()), T.StructField("kind", T.IntegerType())])
_ORDINARY, _REPEAT, _SPREAD = 0, 1, 2


def _windows_of(offsets: np.ndarray, threshold: int, chunk: int):
    """(document, first, last + 1) of the window starts, cut into chunks by place."""
    begin, stop = offsets[:-1], offsets[1:] - threshold + 1
    doc = np.flatnonzero(stop > begin)
    pieces = (stop[doc] - begin[doc] + chunk - 1) // chunk
    which, step = np.repeat(doc, pieces), ranges(pieces)
    lo = begin[which] + step * chunk
    return which, lo, np.minimum(lo + chunk, stop[which])


def _stretches(data, base, end, doc, lo, hi, threshold):
    """Stretches of the windows ``base .. end``: document, first window, width, rank and own rank."""
    ranks, least = _sampled(data, base, end, threshold)
    # Windows that lie inside one document, in order.
    start, count = lo - base, hi - lo
    windows = np.repeat(start, count) + ranges(count)
    owner = np.repeat(doc, count)
    sample = least[windows]
    new = np.ones(len(windows), bool)
    new[1:] = (sample[1:] != sample[:-1]) | (owner[1:] != owner[:-1])
    heads = np.flatnonzero(new)
    tails = np.append(heads[1:], len(windows)) - 1
    a, b, p = windows[heads], windows[tails], sample[heads]
    rest = threshold - threshold // 2
    shape = (p - a) * threshold + (b - a)
    stretch = pair(pair(ranks[a], ranks[a + rest]), pair(ranks[b + rest], shape.astype(U)))
    return owner[heads], a + base, b - a, ranks[p].view(np.int64), stretch.view(np.int64)


def _round_1(threshold: int, chunk: int, hot: int, combined: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def flush() -> pa.RecordBatch:
            d, t, first, more, rank, stretch = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            keep, again = _first_of([rank, stretch], [d, t, first])
            rows = np.concatenate([keep, again])
            # A rank with many stretches here: two stay with it, the others are dealt by
            # their own rank. They have company for certain, so they stay open.
            run = np.flatnonzero(np.diff(rank[keep], prepend=rank[keep][:1] - 1))
            size = np.diff(np.append(run, len(keep)))
            kind = np.full(len(rows), _REPEAT, np.int32)
            kind[:len(keep)] = np.where((np.repeat(size, size) > hot) & (ranges(size) > 1),
                                        _SPREAD, _ORDINARY)
            d, t, first, more, rank, stretch = (x[rows] for x in (d, t, first, more, rank, stretch))
            # Repeats are settled here; their place spreads them.
            alone = pair(stretch.view(U), np.where(kind == _REPEAT, first + d, 0).astype(U))
            dealt = np.where(kind != _ORDINARY, alone.view(np.int64), rank)
            stretch = np.where(kind == _REPEAT, 0, stretch)  # settled: one number less to shuffle
            return pa.RecordBatch.from_arrays(
                [pa.array(x) for x in (dealt, stretch, d, t, first * threshold + more, kind)],
                names=_ROUND_1.names)

        size = 0
        for batch in batches:
            data, offsets = text_bytes(batch.column("_x"))
            ids = batch.column("_d").to_numpy()
            ties = batch.column("_t").to_numpy()
            doc, lo, hi = _windows_of(offsets, threshold, chunk)
            at = 0
            while at < len(doc):
                stop = max(at + 1, int(np.searchsorted(hi, lo[at] + chunk, "right")))
                base, end = int(lo[at]), int(hi[stop - 1])
                own, first, more, rank, stretch = _stretches(
                    data, base, end, doc[at:stop], lo[at:stop], hi[at:stop], threshold)
                held.append((ids[own], ties[own], first - offsets[own], more, rank, stretch))
                size += end - base
                if size >= combined:
                    yield flush()
                    size = 0
                at = stop
        if held:
            yield flush()
    return run


_ROUND_2 = T.StructType([
    T.StructField("rank", T.LongType()), T.StructField("_d", T.LongType()),
    T.StructField("_t", T.LongType()), T.StructField("place", T.LongType()),
    T.StructField("kind", T.IntegerType())])


def _round_2(threshold: int, chunk: int):
    half = threshold // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def flush() -> pa.RecordBatch:
            rank, d, t, q = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            keep, again = _first_of([rank], [d, t, q])
            rows = np.concatenate([keep, again])
            dealt = rank.copy()
            dealt[again] = pair(rank[again].view(U), (d[again] + q[again]).astype(U)).view(np.int64)
            return pa.RecordBatch.from_arrays([
                pa.array(x[rows]) for x in (dealt, d, t, q * threshold)
            ] + [pa.array((np.arange(len(rows)) >= len(keep)).astype(np.int32) * _REPEAT)],
                names=_ROUND_2.names)

        size = 0
        for batch in batches:
            for x, d, t, spans in zip(*(batch.column(c) for c in ("_x", "_d", "_t", "_open")),
                                      strict=True):
                if not spans.is_valid:
                    continue
                data = np.frombuffer(x.as_buffer(), np.uint8)
                place = spans.values.to_numpy()
                lo, count = place // threshold, place % threshold + 1
                q = np.unique(np.repeat(lo, count) + ranges(count))
                # Neighbouring windows share their ranks: take runs of them.
                for part in np.split(q, np.flatnonzero(np.diff(q) > threshold) + 1):
                    for some in np.array_split(part, len(part) // chunk + 1):
                        base = int(some[0])
                        ranks = prefix_ranks(data[base:int(some[-1]) + threshold], half)
                        w = some - base
                        n = len(w)
                        held.append((pair(ranks[w], ranks[w + threshold - half]).view(np.int64),
                                     np.full(n, d.as_py()), np.full(n, t.as_py()), some))
                        size += n
                        if size >= chunk // 4:
                            yield flush()
                            size = 0
        if held:
            yield flush()
    return run


_RESULT = T.StructType([
    T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()),
    T.StructField("spans", T.ArrayType(T.StructType([
        T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
    T.StructField("kept", T.BinaryType()), T.StructField("kept_text", T.StringType())])
_SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64())])


def merged(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of overlapping or touching half-open ranges."""
    order = np.argsort(lo, kind="stable")
    lo, hi = lo[order], np.maximum.accumulate(hi[order])
    new = np.ones(len(lo), bool)
    new[1:] = lo[1:] > hi[:-1]
    heads = np.flatnonzero(new)
    return lo[heads], hi[np.append(heads[1:], len(lo)) - 1]


def _cut(threshold: int, ids: list[str], with_text: bool, chunk: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, offsets = text_bytes(batch.column("_x"))
            for lo, hi in slices(offsets, chunk):
                part = batch.slice(lo, hi - lo)
                spans, removed, kept = [], [], []
                for x, runs in zip(part.column("_x"), part.column("_runs"), strict=True):
                    data = x.as_buffer()
                    a = b = np.empty(0, np.int64)
                    if runs.is_valid:
                        place = runs.values.to_numpy()
                        start = place // threshold
                        a, b = merged(start, start + place % threshold + threshold)
                    removed.append(int((b - a).sum()))
                    spans.append([{"start": int(i), "end": int(j)} for i, j in zip(a, b, strict=True)])
                    edges = [0, *np.stack([a, b], 1).ravel().tolist(), len(data)]
                    whole = memoryview(data)
                    parts = [bytes(whole[i:j]) for i, j in zip(edges[::2], edges[1::2], strict=True)]
                    # A cut inside a character takes the rest of the character with it.
                    kept.append("".join([p.decode(errors="ignore") for p in parts]) if with_text
                                else b"".join(parts))
                size = np.diff(offsets[lo:hi + 1])
                none = pa.nulls(hi - lo, pa.binary() if with_text else pa.string())
                made = [none, pa.array(kept, pa.string())] if with_text else [pa.array(kept, pa.binary()), none]
                yield pa.RecordBatch.from_arrays([
                    *[part.column(c) for c in ids], pa.array(size, pa.int64()), pa.array(removed, pa.int64()),
                    pa.array(spans, pa.list_(_SPAN)), *made], names=[*ids, *_RESULT.names])
    return run


def _place() -> Column:
    return F.struct("_d", "_t", "place")


def repeated_spans(docs: DataFrame, keep: Sequence[str] = ("doc_id",), doc_id: str = "doc_id",
                   text: str = "text", threshold: int = THRESHOLD, chunk: int = CHUNK,
                   hot: int = HOT, with_text: bool = False, combined: int = COMBINED) -> DataFrame:
    """``keep``, n_bytes, n_removed, spans (byte ranges to remove), kept (bytes) and kept_text.

    One row for each row of ``docs``. Of ``kept`` and ``kept_text`` the one that
    ``with_text`` asks for is made, the other is null; ``kept_text`` lacks what remains of a
    character that a span cuts.
    """
    if threshold < 4 or threshold % 2:
        raise ValueError("the threshold must be even and at least 4")
    ids = [f"_k{i}" for i in range(len(keep))]
    rows = _keys(docs, doc_id, text, keep)
    sampled = rows.select("_x", "_d", "_t").mapInArrow(_round_1(threshold, chunk, hot, combined), _ROUND_1)
    # Round 1: one shuffle by rank; equal stretches, and ranks with several stretches.
    same = Window.partitionBy("rank", "stretch").orderBy("_d", "_t", "place")
    alike = Window.partitionBy("rank")
    judged = sampled.select("*", F.first(_place()).over(same).alias("_head")).select(
        "*", (F.min("stretch").over(alike) != F.max("stretch").over(alike)).alias("_many"))
    repeat = (F.col("kind") == _REPEAT) | (F.col("_head") != _place())
    found = stage(judged.select("_d", "_t", "place", repeat.alias("repeat"), "_many", "kind").where(
        (F.col("kind") == _SPREAD) | F.col("repeat") | F.col("_many")).select(
        "_d", "_t", "place", "repeat"))
    del sampled, judged
    release(docs.sparkSession)  # the shuffle of round 1
    # Round 2: windows of the open stretches, by rank pairs.
    opened = found.where("NOT repeat").groupBy("_d", "_t").agg(F.collect_list("place").alias("_open"))
    pairs = rows.join(opened, ["_d", "_t"], "left").select(*ids, "_x", "_d", "_t", "_open").mapInArrow(
        _round_2(threshold, chunk), _ROUND_2)
    equal = Window.partitionBy("rank").orderBy("_d", "_t", "place")
    hits = pairs.select("*", F.first(_place()).over(equal).alias("_head")).where(
        (F.col("kind") == _REPEAT) | (F.col("_head") != _place())).select("_d", "_t", "place")
    runs = found.where("repeat").select("_d", "_t", "place").unionByName(hits).groupBy(
        "_d", "_t").agg(F.collect_list("place").alias("_runs"))
    # The same shuffle of the same columns as in round 2: Spark reuses it.
    cut = rows.join(runs, ["_d", "_t"], "left").select(*ids, "_x", "_d", "_t", "_runs").mapInArrow(
        _cut(threshold, ids, with_text, 4 * chunk), T.StructType([*[rows.schema[i] for i in ids], *_RESULT.fields]))
    return cut.select(*[F.col(i).alias(c) for c, i in zip(keep, ids, strict=True)], *_RESULT.names)


@query("op1_suffix_dedup")
def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = repeated_spans(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"),
                      F.sha2("kept", 256).alias("kept_sha256"))
