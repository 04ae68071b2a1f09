"""Quality scores by a generalised additive model with pairwise interactions.

Each text becomes a few figures (shares of symbols, capitals, repeated words and the
like). Figures are cut into bins at quantiles of the labelled sample. The model is a sum of
lookup tables, one for each figure, and tables over pairs of bins for the pairs that gain
most. They are learned by cyclic boosting: round after round, each figure in turn gets a
shallow tree on the current gradient, scaled down and added to its table. A score is the
logistic of the bins' summed entries, so scoring is additions over whole arrays.

The sample has at most ``sample_rows`` labelled rows, those with the smallest hash of the
id, so that it's the same on every run; it is the only thing that reaches the driver.
Figures and scores cover every row and every whole text.

Edge cases: a null text is empty, its figures are 0 and it's scored like any other;
labels that are null or don't belong to a document are left out, several labels of a
document count each; without labels of both kinds every score is the share of ones (0.5
without labels); a null id isn't held out and never learned from; repeated rows are scored
each; an empty table gives an empty result. Further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm.langid import held_out
from corpusloom.llm.registry import query, table
from corpusloom.llm.share import opened, shared
from corpusloom.llm.textgrams import pair, slices, text_bytes, word_bounds, word_ranks
from corpusloom.operators.split import sample_n
from corpusloom.storage import stage

SAMPLE_ROWS = 20_000
BINS = 32
ROUNDS = 200
RATE = 0.1
LEAVES = 4
PAIRS = 5
PAIR_ROUNDS = 60
THRESHOLD = 0.7
FIGURES = (
    "log_words", "word_length", "symbols", "capitals", "marks", "digits", "repeated_words",
    "repeated_runs", "log_lines", "repeated_lines", "line_words", "longest_word", "single_bars",
)
_TEXT_CHUNK = 1 << 20

_KIND = {name: np.zeros(256, bool) for name in ("symbol", "capital", "mark", "digit", "letter")}
_KIND["symbol"][list(b"#*$%&|<>@^~_=+{}[]\\/")] = True
_KIND["capital"][65:91] = True
_KIND["mark"][list(b"!?.,;:")] = True
_KIND["digit"][48:58] = True
_KIND["letter"][65:91] = _KIND["letter"][97:123] = _KIND["letter"][192:] = True
_LINE = np.zeros(256, bool)
_LINE[10] = True


def _repeats(text: np.ndarray, value: np.ndarray, texts: int) -> np.ndarray:
    """How many values of each text occurred in it before."""
    order = np.lexsort([value, text])
    a, b = text[order], value[order]
    again = (a[1:] == a[:-1]) & (b[1:] == b[:-1])
    return np.bincount(a[1:][again], minlength=texts)


def figures(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A matrix of texts x FIGURES."""
    texts = len(offsets) - 1
    owner = np.repeat(np.arange(texts), np.diff(offsets))
    kind = {k: np.bincount(owner[m[data]], minlength=texts) for k, m in _KIND.items()}
    start, end, of = word_bounds(data, offsets)
    size = end - start
    words = np.bincount(of, minlength=texts)
    rank = word_ranks(data, start, end)
    run = pair(pair(rank[:-2], rank[1:-1]), rank[2:]) if len(rank) > 2 else rank[:0]
    whole = of[:len(run)] == of[len(of) - len(run):]
    line_start, line_end, line_of = word_bounds(data, offsets, _LINE)
    lines = np.bincount(line_of, minlength=texts)
    longest = np.zeros(texts, np.int64)
    np.maximum.at(longest, of, size)
    bars = np.bincount(of[(size == 1) & _KIND["symbol"][data[start]]], minlength=texts)
    some, letters, some_lines = (np.maximum(x, 1) for x in (words, kind["letter"], lines))
    return np.stack([
        np.log1p(words), np.bincount(of, weights=size, minlength=texts) / some,
        kind["symbol"] / some, kind["capital"] / letters, kind["mark"] / some,
        kind["digit"] / letters, _repeats(of, rank, texts) / some,
        _repeats(of[:len(run)][whole], run[whole], texts) / some, np.log1p(lines),
        _repeats(line_of, word_ranks(data, line_start, line_end), texts) / some_lines,
        words / some_lines, np.minimum(longest, 1000), bars / some], axis=1)


def _measure(keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column("_x"))
            for lo, hi in slices(offsets, _TEXT_CHUNK):
                cut = offsets[lo:hi + 1]
                made = figures(data[cut[0]:cut[-1]], cut - cut[0])
                lists = pa.ListArray.from_arrays(
                    np.arange(hi - lo + 1, dtype=np.int32) * len(FIGURES), pa.array(made.ravel()))
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(c).slice(lo, hi - lo) for c in keep], lists],
                    names=[*keep, "figures"])
    return run


def _grow(gradient: np.ndarray, weight: np.ndarray, leaves: int) -> np.ndarray:
    """A shallow tree over ordered bins: the best cuts one by one, then a Newton step per leaf."""
    edges = [0, len(gradient)]
    g, h = np.append(0, np.cumsum(gradient)), np.append(0, np.cumsum(weight))

    def worth(a, b):
        return (g[b] - g[a]) ** 2 / (h[b] - h[a] + 1.0)

    for _ in range(leaves - 1):
        best, gain = None, 1e-9
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            if b - a > 1:
                cuts = np.arange(a + 1, b)
                values = worth(a, cuts) + worth(cuts, b) - worth(a, b)
                if values.max() > gain:
                    best, gain = int(cuts[values.argmax()]), values.max()
        if best is None:
            break
        edges = sorted([*edges, best])
    out = np.empty(len(gradient))
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        out[a:b] = (g[b] - g[a]) / (h[b] - h[a] + 1.0)
    return out


def _grow_pair(gradient: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, float]:
    """A tree of two cuts, one on each axis of a table of bins, and what it gains."""
    g = np.pad(gradient.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    h = np.pad(weight.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    a, b = (np.arange(1, n) for n in gradient.shape)

    def quarters(t):
        top, left, both = t[a][:, -1:], t[-1:, b], t[np.ix_(a, b)]
        return both, top - both, left - both, t[-1, -1] - top - left + both

    parts = list(zip(quarters(g), quarters(h), strict=True))
    value = sum(x ** 2 / (y + 1.0) for x, y in parts)
    i, j = np.unravel_index(value.argmax(), value.shape)
    out = np.empty(gradient.shape)
    for (x, y), rows, columns in zip(
            parts, (slice(0, i + 1), slice(0, i + 1), slice(i + 1, None), slice(i + 1, None)),
            (slice(0, j + 1), slice(j + 1, None), slice(0, j + 1), slice(j + 1, None)), strict=True):
        out[rows, columns] = x[i, j] / (y[i, j] + 1.0)
    return out, float(value.max())


@dataclass
class AdditiveModel:
    """Cut points and tables; ``score`` adds the entries of each row's bins."""

    base: float
    cuts: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> list[np.ndarray]:
        return [np.searchsorted(c, x[:, k], "right") for k, c in enumerate(self.cuts)]

    def score(self, x: np.ndarray) -> np.ndarray:
        at = self.bins(x) if self.cuts else []
        total = np.full(len(x), self.base)
        for one, b in zip(self.tables, at, strict=True):
            total += one[b]
        for (i, j), two in zip(self.pairs, self.pair_tables, strict=True):
            total += two[at[i], at[j]]
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, bins: int = BINS, rounds: int = ROUNDS, rate: float = RATE,
        leaves: int = LEAVES, pairs: int = PAIRS, pair_rounds: int = PAIR_ROUNDS) -> AdditiveModel:
    if len(y) == 0 or y.min() == y.max():
        share = np.clip(y.mean() if len(y) else 0.5, 1e-6, 1 - 1e-6)
        return AdditiveModel(float(np.log(share / (1 - share))))
    base = np.log(y.mean() / (1 - y.mean()))
    cuts = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, bins + 1)[1:-1])) for k in range(x.shape[1])]
    model = AdditiveModel(float(base), cuts, [np.zeros(len(c) + 1) for c in cuts])
    at = model.bins(x)
    total = np.full(len(y), base)

    def slope() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return y - p, p * (1 - p)

    for _ in range(rounds):  # cyclic: each figure in turn, a small step
        for k, one in enumerate(model.tables):
            g, h = slope()
            step = rate * _grow(np.bincount(at[k], g, len(one)), np.bincount(at[k], h, len(one)), leaves)
            one += step
            total += step[at[k]]

    def grid(i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
        shape = (len(model.tables[i]), len(model.tables[j]))
        g, h = slope()
        cell = at[i] * shape[1] + at[j]
        return tuple(np.bincount(cell, v, shape[0] * shape[1]).reshape(shape) for v in (g, h))

    wide = [k for k, one in enumerate(model.tables) if len(one) > 1]
    gains = sorted(((-_grow_pair(*grid(i, j))[1], i, j) for i in wide for j in wide if i < j))
    model.pairs = [(i, j) for _, i, j in gains[:pairs]]
    model.pair_tables = [np.zeros((len(model.tables[i]), len(model.tables[j]))) for i, j in model.pairs]
    for _ in range(pair_rounds):
        for (i, j), two in zip(model.pairs, model.pair_tables, strict=True):
            step = rate * _grow_pair(*grid(i, j))[0]
            two += step
            total += step[at[i], at[j]]
    return model


def _apply(model, keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        additive: AdditiveModel = opened(model)
        for batch in batches:
            flat = batch.column("figures").flatten().to_numpy(zero_copy_only=False)
            score = additive.score(flat.reshape(-1, len(FIGURES)))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(score)],
                                             names=[*keep, "score"])
    return run


def measured(docs: DataFrame, keep: Sequence[str] = ("doc_id",), text: str = "text") -> DataFrame:
    """``keep`` and the figures of each row's whole text, written once."""
    ids = [f"_k{i}" for i in range(len(keep))]
    rows = docs.select(*[F.col(c).alias(i) for c, i in zip(keep, ids, strict=True)],
                       F.coalesce(F.col(text), F.lit("")).alias("_x"))
    schema = T.StructType([*[rows.schema[i] for i in ids],
                           T.StructField("figures", T.ArrayType(T.DoubleType()))])
    return stage(rows.mapInArrow(_measure(ids), schema).select(
        *[F.col(i).alias(c) for c, i in zip(keep, ids, strict=True)], "figures"))


def train(figured: DataFrame, labels: DataFrame, doc_id: str = "doc_id", label: str = "quality",
          sample_rows: int = SAMPLE_ROWS) -> AdditiveModel:
    """The model of labelled rows of ``measured`` outside the held-out quarter."""
    known = labels.where(F.col(label).isNotNull()).select(
        F.col(doc_id).alias("_i"), F.col(label).cast("int").alias("_y")).where(
        F.col("_i").isNotNull() & ~held_out("_i"))
    learned = stage(figured.select(F.col(doc_id).alias("_d"), "figures").join(
        known, F.col("_d") == F.col("_i")).select("_i", "figures", "_y"))
    # Rows of one id differ in label or figures; what is equal in all of them is interchangeable.
    learned = learned.withColumn("_key", F.concat_ws(":", "_i", "_y", F.xxhash64("figures")))
    sample = sample_n(learned, sample_rows, "_key", 1).toArrow()
    # In one order, so that sums are the same on every run.
    sample = sample.sort_by([("_y", "ascending"), ("_key", "ascending")])
    flat = sample.column("figures").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return fit(flat.reshape(-1, len(FIGURES)), sample.column("_y").to_numpy().astype(float))


def scored(figured: DataFrame, model: AdditiveModel, keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """``keep`` and the score of each row of ``measured``."""
    ids = [f"_k{i}" for i in range(len(keep))]
    rows = figured.select(*[F.col(c).alias(i) for c, i in zip(keep, ids, strict=True)], "figures")
    held = shared(figured.sparkSession, model)
    schema = T.StructType([*[rows.schema[i] for i in ids], T.StructField("score", T.DoubleType())])
    return rows.mapInArrow(_apply(held, ids), schema).select(
        *[F.col(i).alias(c) for c, i in zip(keep, ids, strict=True)], "score")


@query("op10_additive_quality")
def op10_additive_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    figured = measured(table(spark, sf_dir, "documents"))
    model = train(figured, table(spark, sf_dir, "labels"))
    return scored(figured, model).select(
        "doc_id", held_out().alias("held_out"), "score",
        F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))
