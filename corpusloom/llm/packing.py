"""Packing of token sequences: first-fit decreasing with a tournament tree, in random groups.

Documents become ids (and an end id); a document longer than a sequence is cut into full
sequences and a rest. Full ones need no packing. The rests are dealt at random into groups
of about ``group_rows``, however they are distributed, so no key is hot; each group packs
its rests by falling length into the leftmost sequence with room. A tournament tree over
the sequences' free places finds it in log2(n) steps.

Texts are turned into ids in one map; equal words of a batch are encoded once. What is
shuffled are rows of numbers, one for each piece.

Edge cases: a null text is empty and gives one piece with the end id alone; rows with
null or repeated ids are packed one by one; an empty table gives an empty result. Further
columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm.registry import query, table
from corpusloom.llm.textgrams import U, pair, ranges, slices, text_bytes, word_bounds, word_ranks
from corpusloom.storage import stage

SEQUENCE = 2048
END_ID = 1
GROUP_ROWS = 4096
_CACHE_WORDS = 1_000_000
_TEXT_CHUNK = 1 << 21


def tournament_first_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each size, packed first-fit in the order of falling size.

    The tree's leaves are the bins' free places, each inner node the larger of its two;
    going down to the left wherever there is room gives the first bin that fits.
    """
    n = len(sizes)
    width = 1
    while width < n:
        width *= 2
    free = [capacity] * (2 * width)
    bins, offsets = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for item in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[item])
        if size > capacity:
            raise ValueError("a piece is longer than a sequence")
        node = 1
        while node < width:
            node *= 2
            if free[node] < size:
                node += 1
        bins[item], offsets[item] = node - width, capacity - free[node]
        free[node] -= size
        node //= 2
        while node:
            best = max(free[2 * node], free[2 * node + 1])
            if free[node] == best:
                break
            free[node] = best
            node //= 2
    return bins, offsets


#: Bytes of words that may be cut into runs of letters, digits and marks: ASCII but for
#: quotes (contractions) and < | (special tokens), and the Latin letters that start with 0xC3.
_RUN = np.zeros(256, np.int8)
_RUN[33:127] = 3
_RUN[48:58] = 2
_RUN[65:91] = _RUN[97:123] = 1
_RUN[0x80:0xC0] = _RUN[0xC3] = 1
_RUN[[0x27, 0x3C, 0x7C, 0x97, 0xB7]] = 0
_JOINED = 256


def runs_of(data: np.ndarray, offsets: np.ndarray):
    """Words between white space, those of plain letters and marks cut into runs of one kind.

    Gives the bytes (capitals of cut words in lower case), starts, ends, texts and whether a
    run is of letters alone.
    """
    start, end, owner = word_bounds(data, offsets)
    kind = _RUN[data]
    odd = np.append(0, np.cumsum(kind == 0))
    plain = odd[end] == odd[start]
    inside = np.zeros(len(data) + 1, np.int8)
    inside[start[plain]] += 1
    inside[end[plain]] -= 1
    inside = np.cumsum(inside[:-1], dtype=np.int8).astype(bool)
    begins = np.zeros(len(data), bool)
    begins[start] = True
    begins[1:] |= inside[1:] & inside[:-1] & (kind[1:] != kind[:-1])
    first = np.flatnonzero(begins)
    word = np.searchsorted(start, first, "right") - 1
    last = np.minimum(np.append(first[1:], len(data)), end[word])
    lowered = np.where(inside & (data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
    return lowered, first, last, owner[word], plain[word] & (kind[first] == 1)


class WordEncoder:
    """Ids of texts by a tokenizer that lower-cases and never joins what white space parts.

    It also never joins letters with marks or digits, so such runs are encoded once and
    kept while the cache has room. Runs of letters are single words to the tokenizer: many
    are encoded in one call and told apart by the ids that end a word.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for piece, i in vocabulary.items() if piece.endswith("</w>")]] = True
        self._clear()

    def _clear(self) -> None:
        self.keys, self.first, self.size = np.empty(0, U), np.empty(0, np.int64), np.empty(0, np.int64)
        self.ids = np.empty(0, np.uint32)

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and the number of ids of each text."""
        lowered, start, end, owner, letters = runs_of(data, offsets)
        rank = pair(word_ranks(lowered, start, end), letters.astype(U))
        distinct, at, which = np.unique(rank, return_index=True, return_inverse=True)
        if len(self.keys) > _CACHE_WORDS:
            self._clear()
        place = np.minimum(np.searchsorted(self.keys, distinct), max(len(self.keys) - 1, 0))
        have = self.keys[place] == distinct if len(self.keys) else np.zeros(len(distinct), bool)
        self._learn(lowered.tobytes(), distinct[~have], start[at[~have]], end[at[~have]],
                    letters[at[~have]])
        place = np.searchsorted(self.keys, distinct)
        per = self.size[place][which]
        ids = self.ids[np.repeat(self.first[place][which], per) + ranges(per)]
        count = np.bincount(owner, weights=per, minlength=len(offsets) - 1).astype(np.int64)
        return ids, count

    def _learn(self, raw: bytes, keys: np.ndarray, start: np.ndarray, end: np.ndarray,
               letters: np.ndarray) -> None:
        order = np.argsort(~letters, kind="stable")
        words = [raw[i:j].decode() for i, j in zip(start[order].tolist(), end[order].tolist(), strict=True)]
        single = int(letters.sum())
        joined = [" ".join(words[i:min(i + _JOINED, single)]) for i in range(0, single, _JOINED)]
        encode = self.tokenizer.encode_batch_fast
        made = [np.array(e.ids, np.uint32) for e in encode(joined, add_special_tokens=False)]
        flat = np.concatenate(made) if made else np.empty(0, np.uint32)
        stop = np.flatnonzero(self.ends[flat]) + 1
        if len(stop) != single:
            raise ValueError("the tokenizer doesn't keep runs of letters apart")
        others = [np.array(e.ids, np.uint32) for e in encode(words[single:], add_special_tokens=False)]
        size = np.concatenate([np.diff(stop, prepend=0), np.array([len(x) for x in others], np.int64)])
        first = len(self.ids) + np.cumsum(size) - size
        self.ids = np.concatenate([self.ids, flat, *others])
        keys = np.concatenate([self.keys, keys[order]])
        sort = np.argsort(keys, kind="stable")
        self.keys = keys[sort]
        self.first = np.concatenate([self.first, first])[sort]
        self.size = np.concatenate([self.size, size])[sort]


_PIECES = T.StructType([
    T.StructField("start", T.LongType()), T.StructField("length", T.LongType()),
    T.StructField("ids_crc32", T.LongType()), T.StructField("doc_tokens", T.LongType()),
    T.StructField("ids", T.ArrayType(T.IntegerType()))])


def _cut(path: str, capacity: int, end_id: int, with_ids: bool):
    import os

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encode = WordEncoder(path)
        for batch in batches:
            data, offsets = text_bytes(batch.column("_x"))
            for lo, hi in slices(offsets, _TEXT_CHUNK):
                cut = offsets[lo:hi + 1]
                ids, count = encode(data[cut[0]:cut[-1]], cut - cut[0])
                begin = np.cumsum(count) - count
                doc, start, length, crc, total, kept = [], [], [], [], [], []
                for d, (b, n) in enumerate(zip(begin.tolist(), count.tolist(), strict=True)):
                    mine = np.append(ids[b:b + n], np.uint32(end_id)).astype("<u4")
                    for s in range(0, n + 1, capacity):
                        piece = mine[s:s + capacity]
                        doc.append(lo + d)
                        start.append(s)
                        length.append(len(piece))
                        crc.append(zlib.crc32(piece.tobytes()))
                        total.append(n + 1)
                        kept.append(piece.astype(np.int32) if with_ids else None)
                columns = [pa.array(x, pa.int64()) for x in (start, length, crc, total)]
                columns.append(pa.array(kept, pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("_k").take(pa.array(doc, pa.int64())), *columns],
                    names=["_k", *_PIECES.names])
    return run


def _pack(capacity: int) -> Callable[[pa.Table], pa.Table]:
    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([("length", "descending"), ("_row", "ascending")])
        bins, offsets = tournament_first_fit(group.column("length").to_numpy(), capacity)
        names = np.minimum.reduceat(group.column("_row").to_numpy()[np.argsort(bins, kind="stable")],
                                    np.flatnonzero(np.diff(np.sort(bins), prepend=-1)))
        return pa.table({"_row": group.column("_row"), "sequence_id": pa.array(names[bins]),
                         "offset": pa.array(offsets)})
    return run


def pack(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text",
         capacity: int = SEQUENCE, end_id: int = END_ID, group_rows: int = GROUP_ROWS,
         seed: int = 0, with_ids: bool = False) -> DataFrame:
    """``doc_id``, start, length, ids_crc32, doc_tokens, ids, sequence_id and offset of each piece.

    ``tokenizer`` is the path of a tokenizer file that every executor can read. ``ids`` is
    null unless ``with_ids``.
    """
    rows = docs.select(F.col(doc_id).alias("_k"), F.coalesce(F.col(text), F.lit("")).alias("_x"))
    schema = T.StructType([rows.schema["_k"], *_PIECES.fields])
    # Written once: the numbering of the pieces below must not change on a second read.
    pieces = stage(rows.mapInArrow(_cut(tokenizer, capacity, end_id, with_ids), schema).withColumn(
        "_row", F.monotonically_increasing_id()))
    rests = pieces.where(F.col("length") < capacity).select("_row", "length")
    groups = rests.count() // group_rows + 1
    placed = rests.withColumn("_g", F.pmod(F.xxhash64("_row", F.lit(seed)), F.lit(groups))).groupBy(
        "_g").applyInArrow(_pack(capacity), "_row long, sequence_id long, offset long")
    full = pieces.where(F.col("length") == capacity).select(
        "*", F.col("_row").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    packed = full.unionByName(pieces.where(F.col("length") < capacity).join(placed, "_row"))
    return packed.select(F.col("_k").alias(doc_id), *_PIECES.names, "sequence_id", "offset")


@query("op6_tournament_packing")
def op6_tournament_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    packed = pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
