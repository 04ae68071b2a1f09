r"""Periodic runs of words, found by block convolution.

A run is a stretch of consecutive words with smallest period q (words q apart are equal)
and at least ``max(least, copies * q)`` words, that no neighbouring word extends.

Periods are searched by dyadic scale: blocks of b words at every b-th place stand for
periods 2b to 4b - 1 (blocks of 4 also for 1 to 7). Words are numbers, and the sum of squared
differences between a block and the words that follow it at each distance comes from exact
integer transforms (``ntt``): it's zero where the block occurs again. In a run with period q
all words but the last q are followed by an equal word at distance q, so at least three
neighbouring blocks occur at that distance; their distance seeds a comparison word by word
at both ends, shorter than a block. A distance found twice for one stretch is a multiple of
its period; the smallest counts (three periods fit into the stretch, so the smallest period
divides every other).

Blocks that can't take part aren't transformed: each of their words must stand again within
the scale's distances, and so must those of two neighbours. What a block finds inside a run
already known, at a multiple of its period, is that run. So work is n log^2 n for n words.

All texts are searched in one map over slices of bounded bytes; nothing is shuffled. A text
is never split: its words and numbers are held by one task.

Edge cases: a null or empty text has no word and no run; texts below ``least`` words have no
run; rows are searched one by one, so repeated rows and null ids give equal results; an empty
table gives an empty result; a period may have up to 2^26 words. Words are compared by
64-bit fingerprints (two different words of a text share one with a chance of 2^-64).
Further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm.ntt import zero_differences
from corpusloom.llm.registry import query, table
from corpusloom.llm.textgrams import ranges, slices, text_bytes, word_bounds, word_ranks

LEAST, COPIES = 24, 3
#: Bytes of text whose words a task holds at once; a longer text is alone.
CHUNK = 1 << 20
#: Numbers in one matrix of transforms; a longer row is alone.
CELLS = 1 << 17


def _numbered(rank: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words as numbers within their text, and the distance to the next equal word (0: none)."""
    n = len(rank)
    order = np.lexsort([rank, owner])
    r, o = rank[order], owner[order]
    same = (r[1:] == r[:-1]) & (o[1:] == o[:-1])
    number = np.cumsum(np.append(True, ~same)) - 1
    first = np.append(True, o[1:] != o[:-1])
    number -= np.repeat(number[first], np.diff(np.append(np.flatnonzero(first), n)))
    out, gap = np.empty(n, np.int64), np.zeros(n, np.int64)
    out[order] = number
    gap[order[:-1][same]] = order[1:][same] - order[:-1][same]
    return out, gap


def _chained(k: np.ndarray, key: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """First row and length of each stretch of consecutive ``k`` with equal keys (sorted)."""
    new = np.ones(len(k), bool)
    new[1:] = k[1:] != k[:-1] + 1
    for c in key:
        new[1:] |= c[1:] != c[:-1]
    head = np.flatnonzero(new)
    return head, np.diff(np.append(head, len(k)))


def _occurrences(x, text_end, t, b, low, high, cells):
    """(row of ``t``, distance) of each block that occurs again at ``low <= distance < high``."""
    top = int(x.max()) + 1 if len(x) else 0  # beyond the text: a number no block has
    width = high - low + b - 1
    step = max(1, cells // (4 * b))
    at, distance = [], []
    for lo in range(0, len(t), step):
        start = t[lo:lo + step, None]
        blocks = x[start + np.arange(b)]
        place = start + low + np.arange(width)
        inside = place < text_end[lo:lo + step, None]
        windows = np.where(inside, x[np.where(inside, place, 0)], top)
        row, lag = np.nonzero(zero_differences(blocks, windows, top))
        at.append(row + lo)
        distance.append(lag + low)
    return np.concatenate(at), np.concatenate(distance)


def _grown(x, t, last, q, b, begin, end, cells):
    """How many words the stretch ``t .. last`` gains to the left and to the right at distance q."""
    left, right = np.zeros(len(t), np.int64), np.zeros(len(t), np.int64)
    step = max(1, cells // b)
    reach = np.arange(b)
    for lo in range(0, len(t), step):
        part = slice(lo, lo + step)
        back = t[part, None] - 1 - reach
        fits = back >= begin[part, None]
        back = np.where(fits, back, 0)
        equal = fits & (x[back] == x[np.where(fits, back + q[part, None], 0)])
        left[part] = np.where(equal.all(1), b, equal.argmin(1))
        ahead = last[part, None] + reach
        fits = ahead + q[part, None] < end[part, None]
        ahead = np.where(fits, ahead, 0)
        equal = fits & (x[ahead] == x[np.where(fits, ahead + q[part, None], 0)])
        right[part] = np.where(equal.all(1), b, equal.argmin(1))
    return left, right


def find_runs(rank: np.ndarray, owner: np.ndarray, texts: int, least: int = LEAST,
              copies: int = COPIES, cells: int = CELLS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and period of all runs of a slice of texts, by start and period.

    ``rank`` names the words, ``owner`` their text (ascending); places count from the
    slice's first word.
    """
    none = np.empty(0, np.int64)
    if len(rank) == 0:
        return none, none, none
    x, gap = _numbered(rank, owner)
    size = np.bincount(owner, minlength=texts)
    begin = np.cumsum(size) - size
    s, e, period = none, none, none
    b, low, high = 4, 1, 8
    longest = int(size.max())
    while max(least, copies * low) <= longest:
        long = np.flatnonzero(size >= max(least, copies * low))
        # Whole blocks with a word at the shortest distance behind them.
        count = (size[long] - low) // b
        doc = np.repeat(long, count)
        k = ranges(count)
        t = begin[doc] + k * b
        near = gap[t[:, None] + np.arange(b)]
        able = np.flatnonzero((near > 0).all(1) & (near.max(1) < high))
        head, chain = _chained(k[able], [doc[able]])
        able = able[np.repeat(chain >= 3, chain)]
        if len(able):
            row, q = _occurrences(x, begin[doc[able]] + size[doc[able]], t[able], b, low, high, cells)
            row = able[row]
            # Inside a known run of a short period, at a multiple of it: that run again.
            known = np.flatnonzero((period <= b // 2) & (e - s >= b))
            if len(known):
                known = known[np.argsort(s[known])]
                spot = np.searchsorted(s[known], t[row], "right") - 1
                over = known[np.maximum(spot, 0)]
                seen = (spot >= 0) & (t[row] + q + b <= e[over]) & (q % period[over] == 0)
                row, q = row[~seen], q[~seen]
            order = np.lexsort([k[row], q, doc[row]])
            row, q = row[order], q[order]
            head, chain = _chained(k[row], [q, doc[row]])
            # A stretch this long holds so many whole blocks.
            must = (np.maximum(least - q[head], (copies - 1) * q[head]) - b + 1) // b
            head, chain = head[chain >= must], chain[chain >= must]
            first, dist, own = t[row[head]], q[head], doc[row[head]]
            last = first + chain * b
            left, right = _grown(x, first, last, dist, b, begin[own], begin[own] + size[own], cells)
            lo, hi = first - left, last + right + dist
            good = hi - lo >= np.maximum(least, copies * dist)
            s, e = np.concatenate([s, lo[good]]), np.concatenate([e, hi[good]])
            period = np.concatenate([period, dist[good]])
            order = np.lexsort([period, e, s])
            s, e, period = s[order], e[order], period[order]
            new = np.append(True, (s[1:] != s[:-1]) | (e[1:] != e[:-1])) if len(s) else np.empty(0, bool)
            s, e, period = s[new], e[new], period[new]
        if high > 8:
            b *= 2
        low, high = high, 2 * high
    order = np.lexsort([period, s])
    return s[order], e[order], period[order]


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_RUN_TYPE = T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")])


def _searched(data: np.ndarray, offsets: np.ndarray, least: int, copies: int) -> list[pa.Array]:
    """n_words, runs and collapsed of each text of a slice."""
    texts = len(offsets) - 1
    start, end, owner = word_bounds(data, offsets)
    size = np.bincount(owner, minlength=texts)
    begin = np.cumsum(size) - size
    s, e, period = find_runs(word_ranks(data, start, end), owner, texts, least, copies)
    own = owner[s]
    runs = pa.ListArray.from_arrays(
        pa.array(np.searchsorted(own, np.arange(texts + 1)).astype(np.int32)),
        pa.StructArray.from_arrays([pa.array(s - begin[own]), pa.array(e - s), pa.array(period)],
                                   fields=list(_RUN)))
    # Words behind the first period of any run go.
    change = np.zeros(len(start) + 1, np.int64)
    np.add.at(change, s + period, 1)
    np.add.at(change, e, -1)
    stay = np.flatnonzero(np.cumsum(change[:-1]) == 0)
    width = end[stay] - start[stay]
    closed = np.append(owner[stay][1:] != owner[stay][:-1], True) if len(stay) else np.empty(0, bool)
    room = width + ~closed
    out = np.full(int(room.sum()), 0x20, np.uint8)
    at = np.cumsum(room) - room
    step = ranges(width)
    out[np.repeat(at, width) + step] = data[np.repeat(start[stay], width) + step]
    edge = np.append(0, np.cumsum(np.bincount(owner[stay], weights=room, minlength=texts))).astype(np.int32)
    collapsed = pa.StringArray.from_buffers(texts, pa.py_buffer(edge), pa.py_buffer(out))
    return [pa.array(size.astype(np.int64)), runs, collapsed]


def _run(ids: list[str], least: int, copies: int, chunk: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column("_x"))
            for lo, hi in slices(offsets, chunk):
                cut = offsets[lo:hi + 1]
                made = _searched(data[cut[0]:cut[-1]], cut - cut[0], least, copies)
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(c).slice(lo, hi - lo) for c in ids], *made],
                    names=[*ids, "n_words", "runs", "collapsed"])
    return run


def periodic_runs(docs: DataFrame, keep: Sequence[str] = ("doc_id",), text: str = "text",
                  least: int = LEAST, copies: int = COPIES, chunk: int = CHUNK) -> DataFrame:
    """``keep``, n_words, runs (start, length, period by start, then period) and collapsed.

    One row for each row of ``docs``. ``collapsed`` is the text without the words that a run
    holds behind its first period, its words joined by one space.
    """
    if copies < 3 or least < 24:
        raise ValueError("runs have three copies and 24 words at least")
    ids = [f"_k{i}" for i in range(len(keep))]
    rows = docs.select(*[F.col(c).alias(i) for c, i in zip(keep, ids, strict=True)],
                       F.coalesce(F.col(text), F.lit("")).alias("_x"))
    schema = T.StructType([*[rows.schema[i] for i in ids], T.StructField("n_words", T.LongType()),
                           T.StructField("runs", T.ArrayType(_RUN_TYPE)),
                           T.StructField("collapsed", T.StringType())])
    return rows.mapInArrow(_run(ids, least, copies, chunk), schema).select(
        *[F.col(i).alias(c) for c, i in zip(keep, ids, strict=True)], "n_words", "runs", "collapsed")


def looped(doc_id: str = "doc_id", text: str = "text") -> Column:
    """The text; for a tenth of the ids its words repeat with one period from some place on.

    With h = crc32 of the decimal id and g = h div 10, if h % 10 = 0 each of n > 0 words from
    a = g % n on becomes word ``a + (i - a) % p``, where p = 1 + (n - a) div (3 + g % 8). A
    null id changes nothing.
    """
    return F.expr(rf"""
        IF(crc32(CAST(CAST({doc_id} AS STRING) AS BINARY)) % 10 = 0 AND {text} IS NOT NULL,
           transform(array(named_struct('w', regexp_extract_all({text}, '[^\\x20\\x09-\\x0D]+', 0),
                                        'g', crc32(CAST(CAST({doc_id} AS STRING) AS BINARY)) div 10)),
             v -> IF(size(v.w) = 0, '', array_join(
               transform(array(named_struct('a', CAST(v.g % size(v.w) AS INT))),
                 y -> transform(array(1 + CAST((size(v.w) - y.a) div (3 + v.g % 8) AS INT)),
                   p -> transform(v.w, (x, i) -> IF(i < y.a, x, v.w[y.a + (i - y.a) % p]))))[0][0],
               ' ')))[0],
           {text})""")


def strongest(runs: str = "runs") -> Column:
    """The run of the greatest length / period, the first of equals; null without a run."""
    return F.expr(f"""aggregate({runs}, get({runs}, 0),
        (best, r) -> IF(r.length * best.period > best.length * r.period, r, best))""")


@query("op13_periodic_runs")
def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", looped().alias("text"))
    found = periodic_runs(docs).withColumn("best", strongest())
    lines = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\\n')), '')")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
