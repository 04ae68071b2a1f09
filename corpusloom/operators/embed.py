"""Batch text embedding with an exchangeable encoder."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.resource import ResourceProfile
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from corpusloom.operators.batches import spread, to_lists

Encoder = Callable[[pa.Array], np.ndarray]

#: Text that a task holds to order it by length.
WINDOW_BYTES = 32 * 1024 * 1024


class HashingEncoder:
    """Every word adds +1 or -1 at a place given by its md5; then L2-normalised.

    The first eight hex digits give the place, the ninth the sign. Null or
    blank text gives a zero vector. Distinct words of a batch are hashed once.
    """

    def __init__(self, dim: int = 384):
        self.dim = dim

    def __call__(self, texts: pa.Array) -> np.ndarray:
        split = pc.utf8_split_whitespace(pc.fill_null(texts, ""))
        owner = pc.list_parent_indices(split).to_numpy(zero_copy_only=False)
        coded = pc.list_flatten(split).dictionary_encode()
        vocabulary = coded.dictionary.to_pylist()
        which = coded.indices.to_numpy(zero_copy_only=False)
        out = np.zeros((len(texts), self.dim))
        if len(which):
            digests = b"".join([hashlib.md5(w.encode()).digest() for w in vocabulary])
            octets = np.frombuffer(digests, dtype=np.uint8).reshape(-1, 16)
            place = octets[:, :4].copy().view(">u4").ravel().astype(np.int64) % self.dim
            sign = np.where(octets[:, 4] < 128, 1.0, -1.0)
            sign[[w == "" for w in vocabulary]] = 0.0
            out = np.bincount(owner * self.dim + place[which], weights=sign[which],
                              minlength=out.size).reshape(out.shape)
        length = np.sqrt((out ** 2).sum(axis=1, keepdims=True))
        return np.divide(out, length, out=np.zeros_like(out), where=length > 0)


def text_lengths(texts: pa.Array) -> np.ndarray:
    """Code points of each text; none for null."""
    return pc.fill_null(pc.utf8_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def _cuts(lengths: np.ndarray, batch_size: int, batch_cells: int | None) -> Iterator[tuple[int, int]]:
    """Batches over ascending lengths: rows times the longest stay within ``batch_cells``."""
    at = 0
    while at < len(lengths):
        end = min(at + batch_size, len(lengths))
        if batch_cells is not None:
            cells = lengths[at:end] * np.arange(1, end - at + 1)
            end = at + max(1, int(np.searchsorted(cells, batch_cells, side="right")))
        yield at, end
        at = end


def _windows(batches: Iterator[pa.RecordBatch], text: str, limit: int) -> Iterator[pa.Table]:
    """Consecutive rows together, up to ``limit`` bytes; one batch at least."""
    held, size = [], 0
    for batch in batches:
        if batch.num_rows == 0:
            continue
        own = batch.column(text).nbytes
        if held and size + own > limit:
            yield pa.Table.from_batches(held)
            held, size = [], 0
        held.append(batch)
        size += own
    if held:
        yield pa.Table.from_batches(held)


def embed_text(
    df: DataFrame,
    keep: Sequence[str],
    make_encoder: Callable[[], Encoder] = HashingEncoder,
    text: str = "caption",
    batch_size: int = 512,
    name: str = "embedding",
    batch_cells: int | None = None,
    lengths: Callable[[pa.Array], np.ndarray] = text_lengths,
    window_bytes: int = WINDOW_BYTES,
    profile: ResourceProfile | None = None,
) -> DataFrame:
    """Append ``name array<float>``; ``make_encoder`` runs once per task.

    An encoder takes a string array and gives a matrix with a row per text. Encoders that pad a
    batch to its longest text work in proportion to rows times that length, so texts of a task are
    ordered by ``lengths`` (code points, unless a tokenizer's count is given) within windows of
    ``window_bytes`` of text, and a batch takes neighbours: at most ``batch_size`` of them and, if given, at
    most ``batch_cells`` padded cells. A longer text is a batch of its own, never cut. Nothing is
    shuffled for it, and a row's vector doesn't depend on its batch if the encoder masks padding.

    ``profile`` asks for executors with the resources that the encoder needs, such as GPUs. Null
    texts reach the encoder as null.
    """
    source = spread(df.select(*dict.fromkeys([*keep, text])))
    schema = T.StructType([source.schema[c] for c in keep]
                          + [T.StructField(name, T.ArrayType(T.FloatType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = None
        for window in _windows(batches, text, window_bytes):
            encoder = encoder or make_encoder()
            sizes = np.concatenate([lengths(c) for c in window.column(text).chunks])
            order = np.argsort(sizes, kind="stable")
            for at, end in _cuts(sizes[order], batch_size, batch_cells):
                part = window.take(pa.array(order[at:end])).combine_chunks().to_batches()[0]
                vectors = np.asarray(encoder(part.column(text)), dtype=np.float32)
                if len(vectors) != part.num_rows:
                    raise ValueError(f"{len(vectors)} vectors for {part.num_rows} texts")
                yield pa.RecordBatch.from_arrays(
                    [part.column(c) for c in keep] + [to_lists(vectors, pa.float32())],
                    names=[*keep, name])

    return source.mapInArrow(run, schema, profile=profile)
