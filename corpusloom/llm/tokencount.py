"""Token counts by rank-synchronous merging of arrays.

A text is cut into pre-tokens before each run of spaces; no piece of the vocabulary has a
space after another character, so no merge crosses a cut. The distinct pre-tokens of a
batch that haven't been counted yet lie side by side in one ragged array of symbols. In
each round every sequence finds its pairs of lowest rank, all these pairs merge at once
(of overlapping ones every second, from the left), and the array closes up; sequences
without a mergeable pair leave. What survives are the tokens.

Where the table orders merges by growth, as trained ones do (a pair ranks after the merges that
made its symbols), a long sequence isn't held up by one lowest pair: a pair that is lowest among the
``reach`` pairs on both sides merges as well, ``reach`` being the length of the longest piece.
Nothing can get at its symbols first: pairs between them and the edge of that window rank later, so
only a symbol that grows in from beyond the edge could, and it would be longer than any piece. Nor do
the pairs that it forms come before its turn. So rounds grow with the length of pieces, not of texts.

Counts are those of the sentencepiece library with its default options: a space in front
of the text, spaces as U+2581, pairs of highest score first, characters that no piece has
as one token for each byte. Counting is one map; equal pre-tokens are counted once.

Edge cases: a null or empty text has no token; a text of spaces alone is one pre-token;
rows with null or repeated ids are counted one by one; an empty table gives an empty
result. Further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm.registry import query, table
from corpusloom.llm.textgrams import (
    U, pair, ranges, slices, text_bytes, window_min, word_bounds, word_ranks)

TOKEN_LIMIT = 4096
_CACHE_WORDS = 1_000_000
_TEXT_CHUNK = 1 << 20
_MARK = "▁"
_NO_RANK = np.iinfo(np.int64).max >> 1
_SPACE = np.zeros(256, bool)
_SPACE[0x20] = True


class MergeTable:
    """Symbols, and the rank and result of each pair of symbols that forms a piece."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        score = {}
        for i in range(model.get_piece_size()):
            if not (model.is_control(i) or model.is_byte(i) or model.is_unknown(i)):
                score[model.id_to_piece(i)] = model.get_score(i)
        if any(_MARK in piece.lstrip(_MARK) for piece in score):
            raise ValueError("a piece has a space after another character")
        # Single characters first, with or without a piece of their own.
        singles = sorted({c for piece in score for c in piece})
        symbol = {c: i for i, c in enumerate(singles)}
        for piece in score:
            symbol.setdefault(piece, len(symbol))
        self.points = np.array([ord(c) for c in singles])
        order = {s: r for r, s in enumerate(sorted(set(score.values()), reverse=True))}
        rows = []
        for piece, value in score.items():
            for cut in range(1, len(piece)):
                left, right = symbol.get(piece[:cut]), symbol.get(piece[cut:])
                if left is not None and right is not None:
                    rows.append((left, right, order[value], symbol[piece]))
        left, right, rank, made = np.array(rows, np.int64).reshape(-1, 4).T
        self.width = len(symbol) + 1  # the last number: a character that no piece has
        key = left * self.width + right
        at = np.argsort(key)
        self.key, self.rank, self.made = key[at], rank[at], made[at]
        # A surviving character without a piece counts once for each byte.
        self.tokens = np.ones(self.width, np.int64)
        for c, i in symbol.items():
            if c not in score:
                self.tokens[i] = len(c.encode())
        # The longest piece, if every pair ranks after the merges that made its symbols.
        made_at = np.full(self.width, -1)
        made_at[self.made] = self.rank
        grows = (self.rank > made_at[self.key // self.width]) & (self.rank > made_at[self.key % self.width])
        self.reach = max(map(len, symbol)) if grows.all() else None

    def symbols(self, points: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.points, points), len(self.points) - 1)
        return np.where(self.points[at] == points, at, self.width - 1)

    def lookup(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, place in the table) of pairs; a high rank for pairs that form no piece."""
        key = left * self.width + right
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.where(self.key[at] == key, self.rank[at], _NO_RANK), at

    def count(self, symbols: np.ndarray, unknown: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Tokens of each sequence; ``unknown`` has the bytes of characters without a symbol."""
        out = np.zeros(len(size), np.int64)
        value = np.where(symbols == self.width - 1, unknown, 0)
        np.add.at(out, np.repeat(np.arange(len(size)), size), value)
        owner = np.repeat(np.arange(len(size)), size)
        while len(symbols):
            rank, place = self.lookup(symbols[:-1], symbols[1:])
            rank = np.append(np.where(owner[1:] == owner[:-1], rank, _NO_RANK), _NO_RANK)
            begin = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            length = np.diff(np.append(begin, len(symbols)))
            lowest = np.minimum.reduceat(rank, begin)
            merge = self._merging(rank, owner, np.repeat(lowest, length), int(length.max()))
            done = np.repeat(lowest == _NO_RANK, length)
            self._add(out, owner[done], symbols[done])
            symbols[merge] = self.made[place[merge]]
            stay = ~done
            stay[merge + 1] = False
            symbols, owner = symbols[stay], owner[stay]
        return out

    def _add(self, out: np.ndarray, owner: np.ndarray, symbols: np.ndarray) -> None:
        known = symbols < self.width - 1
        np.add.at(out, owner[known], self.tokens[symbols[known]])

    def _merging(self, rank: np.ndarray, owner: np.ndarray, lowest: np.ndarray, longest: int) -> np.ndarray:
        """Places of the pairs that merge in this round; ``lowest`` is that of a pair's sequence."""
        first = rank == lowest
        if self.reach is not None and longest > self.reach:
            edge = np.full(self.reach, _NO_RANK)
            first |= rank == window_min(np.concatenate([edge, rank, edge]), 2 * self.reach + 1)
        least = np.flatnonzero(first & (rank < _NO_RANK))
        if len(least) == 0:
            return least
        if self.reach is None:  # the leftmost of each sequence: its merge may make a lower pair
            return least[np.append(True, owner[least][1:] != owner[least][:-1])]
        # Neighbours overlap, and rank the same: every second one merges. Where an equal pair before
        # them waits for its own turn, they wait with it.
        new = np.append(True, np.diff(least) != 1)
        head = least[np.maximum.accumulate(np.where(new, np.arange(len(least)), 0))]
        ready = (head == 0) | (rank[head - 1] != rank[head])
        return least[((least - head) % 2 == 0) & ready]


class Counter:
    """Token counts of texts, with the counts of pre-tokens seen before."""

    def __init__(self, path: str):
        self.merges = MergeTable(path)
        self.known = (np.empty(0, U), np.empty(0, np.int64))

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        texts = len(offsets) - 1
        if len(data) == 0:
            return np.zeros(texts, np.int64)
        start, end, owner = word_bounds(data, offsets, _SPACE)
        # Spaces before each word: one more before the first of a text.
        new = np.append(True, owner[1:] != owner[:-1]) if len(owner) else np.empty(0, bool)
        spaces = start - np.where(new, offsets[owner] - 1, np.append(0, end[:-1]))
        # A run of spaces at the end of a text stands alone, so does a text of spaces.
        last = np.full(texts, -1)
        last[owner] = np.arange(len(owner))
        tail = offsets[1:] - np.where(last >= 0, end[last] if len(end) else 0, offsets[:-1] - 1)
        tail[np.diff(offsets) == 0] = 0
        ended = np.flatnonzero(tail > 0)
        owner = np.concatenate([owner, ended])
        start = np.concatenate([start, offsets[1:][ended]])
        end = np.concatenate([end, offsets[1:][ended]])
        spaces = np.concatenate([spaces, tail[ended]])
        rank = np.zeros(len(start), U)
        filled = end > start
        rank[filled] = word_ranks(data, start[filled], end[filled])
        rank = pair(rank, spaces.astype(U))
        distinct, at, which = np.unique(rank, return_index=True, return_inverse=True)
        keys, counts = self.known
        place = np.minimum(np.searchsorted(keys, distinct), max(len(keys) - 1, 0))
        have = keys[place] == distinct if len(keys) else np.zeros(len(distinct), bool)
        size = np.zeros(len(distinct), np.int64)
        size[have] = counts[place[have]]
        fresh = at[~have]
        size[~have] = self._count(data, start[fresh], end[fresh], spaces[fresh])
        if len(keys) > _CACHE_WORDS:
            keys, counts = keys[:0], counts[:0]
        keys = np.concatenate([keys, distinct[~have]])
        order = np.argsort(keys, kind="stable")
        self.known = keys[order], np.concatenate([counts, size[~have]])[order]
        return np.bincount(owner, weights=size[which], minlength=texts).astype(np.int64)

    def _count(self, data: np.ndarray, start: np.ndarray, end: np.ndarray,
               spaces: np.ndarray) -> np.ndarray:
        words = end - start
        at = np.repeat(start, words) + ranges(words)
        raw = data[at]
        lead = (raw & 0xC0) != 0x80  # first byte of a character
        points = np.frombuffer(raw.tobytes().decode().encode("utf-32-le"), np.uint32).astype(np.int64)
        own = np.repeat(np.arange(len(start)), words)[lead]
        wide = np.diff(np.append(np.flatnonzero(lead), len(raw)))
        chars = np.bincount(own, minlength=len(start))
        size = chars + spaces
        out = np.full(int(size.sum()), ord(_MARK), np.int64)
        unknown = np.zeros(len(out), np.int64)
        first = np.cumsum(size) - size
        target = np.repeat(first + spaces, chars) + ranges(chars)
        out[target], unknown[target] = points, wide
        return self.merges.count(self.merges.symbols(out), unknown, size)


def _run(path: str, keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = Counter(path)
        for batch in batches:
            data, offsets = text_bytes(batch.column("_x"))
            for lo, hi in slices(offsets, _TEXT_CHUNK):
                cut = offsets[lo:hi + 1]
                made = count(data[cut[0]:cut[-1]], cut - cut[0])
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(c).slice(lo, hi - lo) for c in keep], pa.array(made)],
                    names=[*keep, "n_tokens"])
    return run


def token_counts(docs: DataFrame, model: str, keep: Sequence[str] = ("doc_id",), text: str = "text",
                 limit: int = TOKEN_LIMIT) -> DataFrame:
    """``keep``, n_bytes, n_tokens and over_limit.

    ``model`` is the path of a sentencepiece pair-merge model that every executor can read;
    it must not change texts before merging (no normalisation but the leading space).
    """
    ids = [f"_k{i}" for i in range(len(keep))]
    raw = F.coalesce(F.col(text), F.lit(""))
    # The library reads U+2581 in a text as a space.
    rows = docs.select(*[F.col(c).alias(i) for c, i in zip(keep, ids, strict=True)],
                       F.octet_length(raw).cast("long").alias("n_bytes"),
                       F.replace(raw, F.lit(_MARK), F.lit(" ")).alias("_x"))
    columns = [*ids, "n_bytes"]
    schema = T.StructType([*[rows.schema[c] for c in columns], T.StructField("n_tokens", T.LongType())])
    return rows.mapInArrow(_run(model, columns), schema).select(
        *[F.col(i).alias(c) for c, i in zip(keep, ids, strict=True)], "n_bytes", "n_tokens",
        (F.col("n_tokens") > limit).alias("over_limit"))


@query("op5_rank_synchronous_tokens")
def op5_rank_synchronous_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"),
                        public_tokenizers.path("piece_bpe_32k.model"))
