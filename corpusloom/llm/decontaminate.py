"""Benchmark passages in documents, found through an FM-index of each training shard.

A shard is a slice of the documents that one task holds. Its words become numbers of the
benchmark's vocabulary; words that no benchmark item has can't be part of a match, so only
runs of benchmark words as long as the shortest phrase enter the index, with a separator
after each. The index is a Burrows-Wheeler transform of that sequence (suffixes sorted by
prefix doubling), stored as a wavelet matrix, plus every eighth suffix position. All phrases are searched backwards at once, word by word,
with two rank queries each; occurrences are located by walking back to a sampled
position, and overlapping ones are merged to spans.

Documents never move: one map over them, no shuffle. The phrases are broadcast in blocks
of at most ``block_bytes`` of benchmark text (measured before they are collected; the
phrases of a block take about ten times as much); with more blocks the map is repeated for each,
adding to what is found so far. What is found is written before the next block, so a task
holds the phrases of one block whatever the size of the benchmark.

Edge cases: a null text has no words; an item without words is dropped; a null item id is
the empty string, repeated items count once; rows are searched one by one, so repeated
rows and null ids stay as they are; an empty benchmark finds nothing, an empty table gives
an empty result. Further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm.registry import query, table
from corpusloom.llm.share import opened, shared
from corpusloom.llm.textgrams import ranges, slices, text_bytes, word_bounds, word_ranks
from corpusloom.storage import stage

WINDOW = 13
BLOCK_BYTES = 4 << 20
SHARD_BYTES = 2 << 20
SAMPLE = 8

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Bytes that aren't part of a word, after A-Z became a-z.
_GAP = np.ones(256, bool)
_GAP[0x30:0x3A] = _GAP[0x61:0x7B] = _GAP[0x80:] = False


def words_of(data: np.ndarray, offsets: np.ndarray):
    """Start, end, text and fingerprint of each word."""
    data = _LOWER[data]
    start, end, owner = word_bounds(data, offsets, _GAP)
    return start, end, owner, word_ranks(data, start, end)


class Phrases:
    """Distinct windows of a block of items as rows of vocabulary numbers (from 1)."""

    def __init__(self, items: Sequence[tuple[str, str]], window: int):
        texts = pa.array([text for _, text in items], pa.string())
        _, _, owner, rank = words_of(*text_bytes(texts))
        self.vocabulary, number = np.unique(rank, return_inverse=True)
        number = number + 1
        count = np.bincount(owner, minlength=len(items))
        first = np.cumsum(count) - count
        per = np.where(count >= window, count - window + 1, np.minimum(count, 1))
        item = np.repeat(np.arange(len(items)), per)
        size = np.minimum(count[item], window)
        rows = np.zeros((len(item), window), np.int32)
        for k in range(window):
            have = size > k
            rows[have, k] = number[(first[item] + ranges(per))[have] + k]
        self.rows, which = np.unique(rows, axis=0, return_inverse=True)
        self.size = (self.rows > 0).sum(1)
        # Items of each phrase, as one array cut by offsets.
        links = np.unique(np.stack([which.ravel(), item], 1), axis=0)
        self.item_at = np.searchsorted(links[:, 0], np.arange(len(self.rows) + 1))
        self.item = links[:, 1]
        self.names = np.array([name for name, _ in items], object)


class FMIndex:
    """A full-text index of a sequence of numbers 0 .. ``top``; 0 separates and matches nothing."""

    def __init__(self, sequence: np.ndarray, top: int):
        text = np.append(sequence, 0)
        self.n = n = len(text)
        # Separators rank by place, so no repeat reaches beyond one.
        gap = text == 0
        rank = np.where(gap, np.cumsum(gap) - 1, text + gap.sum())
        order, have = np.argsort(rank, kind="stable"), 1
        while True:  # prefix doubling: sort by (rank, rank at +have) until all are unique
            ahead = np.zeros(n, np.int64)
            ahead[:-have] = rank[have:] + 1
            key = rank * (n + top + 2) + ahead
            order = np.argsort(key, kind="stable")
            in_order = key[order]
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(np.append(False, in_order[1:] != in_order[:-1]))
            have *= 2
            if rank[order[-1]] == n - 1:
                break
        bwt = text[order - 1]
        self.below = np.searchsorted(text[order], np.arange(top + 2))
        self.bwt = bwt
        self.bits = max(1, int(top).bit_length())
        # Wavelet matrix: ones before each place, level by level from the highest bit.
        self.ones, self.zeros = [], []
        level = bwt
        for bit in range(self.bits - 1, -1, -1):
            one = (level >> bit) & 1
            self.ones.append(np.append(0, np.cumsum(one)).astype(np.int32))
            self.zeros.append(n - int(self.ones[-1][-1]))
            level = np.concatenate([level[one == 0], level[one == 1]])
        # Every SAMPLE-th place, and the first of each run: no walk crosses a separator.
        marked = (order % SAMPLE == 0) | (bwt == 0)
        self.marks = np.append(0, np.cumsum(marked)).astype(np.int32)
        self.samples = order[marked]

    def rank(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        """How often ``symbol`` stands before ``place`` in the transform."""
        begin, end = np.zeros_like(place), place
        for depth, bit in enumerate(range(self.bits - 1, -1, -1)):
            one = ((symbol >> bit) & 1).astype(bool)
            ones = self.ones[depth]
            begin = np.where(one, self.zeros[depth] + ones[begin], begin - ones[begin])
            end = np.where(one, self.zeros[depth] + ones[end], end - ones[end])
        return end - begin

    def search(self, rows: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The range of suffixes that start with each row, backwards from its last word."""
        low, high = np.zeros(len(rows), np.int64), np.full(len(rows), self.n, np.int64)
        for back in range(rows.shape[1]):
            alive = np.flatnonzero((size > back) & (low < high))
            if len(alive) == 0:
                break
            symbol = rows[alive, size[alive] - 1 - back]
            low[alive] = self.below[symbol] + self.rank(symbol, low[alive])
            high[alive] = self.below[symbol] + self.rank(symbol, high[alive])
        return low, np.maximum(low, high)

    def locate(self, suffix: np.ndarray) -> np.ndarray:
        """Text positions of suffixes: walk back to a sampled one."""
        at, steps = suffix.copy(), np.zeros(len(suffix), np.int64)
        todo = np.flatnonzero(self.marks[at + 1] == self.marks[at])
        while len(todo):
            symbol = self.bwt[at[todo]]
            at[todo] = self.below[symbol] + self.rank(symbol, at[todo])
            steps[todo] += 1
            todo = todo[self.marks[at[todo] + 1] == self.marks[at[todo]]]
        return self.samples[self.marks[at]] + steps


def find(phrases: Phrases, number: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first word, phrase) of every occurrence in a shard's words."""
    none = np.empty(0, np.int64)
    if len(phrases.rows) == 0 or len(number) == 0:
        return none, none
    # Runs of benchmark words inside a document, long enough for a phrase.
    known = number > 0
    cut = np.ones(len(number), bool)
    cut[1:] = (known[1:] != known[:-1]) | (owner[1:] != owner[:-1])
    heads = np.flatnonzero(cut)
    size = np.diff(np.append(heads, len(number)))
    good = known[heads] & (size >= phrases.size.min())
    heads, size = heads[good], size[good]
    if len(heads) == 0:
        return none, none
    places = np.repeat(heads, size + 1) + ranges(size + 1)
    stop = np.cumsum(size + 1) - 1
    sequence = number[np.minimum(places, len(number) - 1)].copy()
    sequence[stop] = 0
    index = FMIndex(sequence, len(phrases.vocabulary))
    low, high = index.search(phrases.rows, phrases.size)
    count = high - low
    at = index.locate(np.repeat(low, count) + ranges(count))
    return places[at], np.repeat(np.arange(len(count)), count)


_SPAN = T.ArrayType(T.StructType([
    T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def _search(broadcast, shard_bytes: int, columns: list[str], text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases: Phrases = opened(broadcast)
        for batch in batches:
            data, offsets = text_bytes(batch.column(text))
            for lo, hi in slices(offsets, shard_bytes):
                cut = offsets[lo:hi + 1]
                docs = hi - lo
                start, end, owner, rank = words_of(data[cut[0]:cut[-1]], cut - cut[0])
                number = np.searchsorted(phrases.vocabulary, rank)
                number = np.minimum(number, max(len(phrases.vocabulary) - 1, 0))
                if len(phrases.vocabulary):
                    number = np.where(phrases.vocabulary[number] == rank, number + 1, 0)
                first, phrase = find(phrases, number, owner)
                words = np.bincount(owner, minlength=docs)
                before = np.cumsum(words) - words
                # Words that an occurrence covers, with those of earlier blocks.
                edge = np.zeros(len(owner) + 1, np.int64)
                np.add.at(edge, first, 1)
                np.add.at(edge, first + phrases.size[phrase], -1)
                old = batch.column("spans").slice(lo, docs)
                for doc, spans in enumerate(old):
                    for span in spans.as_py() if spans.is_valid else ():
                        edge[before[doc] + span["start"]] += 1
                        edge[before[doc] + span["end"]] -= 1
                hit = np.cumsum(edge[:-1]) > 0
                new = hit.copy()
                new[1:] &= ~hit[:-1] | (owner[1:] != owner[:-1])
                last = hit.copy()
                last[:-1] &= ~hit[1:] | (owner[1:] != owner[:-1])
                a, b = np.flatnonzero(new), np.flatnonzero(last)
                own = owner[a]
                spans = [[] for _ in range(docs)]
                cuts = [[] for _ in range(docs)]
                text_at = cut[own] - cut[0]
                for d, i, j, x, y in zip(own, a - before[own], b + 1 - before[own],
                                         start[a] - text_at, end[b] - text_at, strict=True):
                    spans[d].append({"start": int(i), "end": int(j)})
                    cuts[d].append({"start": int(x), "end": int(y)})
                pairs = np.unique(np.stack([owner[first], phrase], 1), axis=0) if len(first) else (
                    np.empty((0, 2), np.int64))
                of = phrases.item_at[pairs[:, 1] + 1] - phrases.item_at[pairs[:, 1]]
                item = phrases.item[np.repeat(phrases.item_at[pairs[:, 1]], of) + ranges(of)]
                names: list[set] = [set(x.as_py() or ()) for x in batch.column("items").slice(lo, docs)]
                for d, i in np.unique(np.stack([np.repeat(pairs[:, 0], of), item], 1), axis=0):
                    names[d].add(phrases.names[i])
                kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
                made = {"n_words": pa.array(words, pa.int64()),
                        "n_hit": pa.array(np.bincount(owner[hit], minlength=docs), pa.int64()),
                        "spans": pa.array(spans, kind), "cuts": pa.array(cuts, kind),
                        "items": pa.array([sorted(x) for x in names], pa.list_(pa.string()))}
                yield pa.RecordBatch.from_arrays(
                    [made[c] if c in made else batch.column(c).slice(lo, docs) for c in columns],
                    names=columns)
    return run


def benchmark_hits(docs: DataFrame, benchmark: DataFrame, keep: Sequence[str] = ("doc_id",),
                   text: str = "text", item_id: str = "item_id", item_text: str = "text",
                   window: int = WINDOW, block_bytes: int = BLOCK_BYTES,
                   shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """``keep``, n_words, n_hit, spans (in words), cuts (in bytes), items (sorted ids).

    ``keep`` gives the columns by which the caller knows its rows.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("i"),
                             F.col(item_text).alias("t")).where("t IS NOT NULL")
    total = items.agg(F.sum(F.octet_length("t") + F.octet_length("i") + 16)).first()[0] or 0
    blocks = int(total // block_bytes) + 1
    ids = [f"_k{i}" for i in range(len(keep))]
    own = ids[list(keep).index(text)] if text in keep else "_x"
    rows = docs.select(
        *[F.col(c).alias(i) for c, i in zip(keep, ids, strict=True)],
        *([] if text in keep else [F.col(text).alias(own)]),
        F.lit(0).cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_hit"),
        F.lit(None).cast(_SPAN).alias("spans"), F.lit(None).cast(_SPAN).alias("cuts"),
        F.lit(None).cast("array<string>").alias("items"))
    held = None
    for block in range(blocks):
        if held is not None:
            rows = stage(rows)
            held.destroy()
        part = items.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == block).distinct().collect()
        held = shared(spark, Phrases([(r.i, r.t) for r in part], window))
        rows = rows.mapInArrow(_search(held, shard_bytes, rows.columns, own), rows.schema)
    return rows.select(*[F.col(i).alias(c) for c, i in zip(keep, ids, strict=True)],
                       "n_words", "n_hit", "spans", "cuts", "items")


def contaminated(n_hit: str = "n_hit", n_words: str = "n_words"):
    """A twentieth of the words or more stand in benchmark passages."""
    return (F.col(n_hit) > 0) & (F.col(n_hit) * 20 >= F.col(n_words))


@query("op8_fm_decontaminate")
def op8_fm_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = benchmark_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
                        contaminated().alias("contaminated"))
