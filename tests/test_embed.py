"""Batches of an encoder: the same vectors with less padding, whatever the batches."""

import sys

import numpy as np
import pyarrow as pa
import pytest
from pyspark import cloudpickle

from corpusloom.operators import embed
from corpusloom.operators.batches import spread


# The encoder below travels to the tasks, which don't see this file.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def padding_encoder(cells, used, largest=None):
    """An encoder that pads as networks do, and counts the cells it pads to and the used ones."""
    def encode(texts: pa.Array) -> np.ndarray:
        words = ["" if t is None else t for t in texts.to_pylist()]
        width = max(1, *[len(w) for w in words]) if words else 1
        cells.add(width * len(words))
        used.add(sum(len(w) for w in words))
        if largest is not None:
            assert len(words) == 1 or width * len(words) <= largest
        padded = np.zeros((len(words), width))
        for i, w in enumerate(words):
            padded[i, :len(w)] = [ord(c) for c in w]
        return np.stack([padded.sum(axis=1), (padded > 0).sum(axis=1)], axis=1)

    return encode


@pytest.fixture(scope="module")
def texts(spark):
    """Lengths over three orders of magnitude, with null and empty texts, in random order."""
    rng = np.random.default_rng(2)
    sizes = (10 ** rng.uniform(0, 3, size=3000)).astype(int)
    rows = [(i, "ab"[i % 2] * int(n)) for i, n in enumerate(sizes)] + [(3000, None), (3001, "")]
    return spark.createDataFrame(rows, "id long, caption string").repartition(3).cache()


def _run(spark, texts, **options):
    cells, used = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)
    largest = options.get("batch_cells")
    made = embed.embed_text(texts, ["id"], lambda: padding_encoder(cells, used, largest), **options)
    return {r[0]: list(r[1]) for r in made.collect()}, 1 - used.value / cells.value


def test_padding_is_more_than_halved(spark, texts):
    ordered, share = _run(spark, texts, batch_size=64)
    # One window for each Arrow batch of 64 rows: batches as the rows come.
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")
    try:
        as_read, before = _run(spark, texts, batch_size=64, window_bytes=1)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert ordered == as_read and len(ordered) == 3002
    assert share < 0.5 * before
    assert ordered[3000] == ordered[3001] == [0.0, 0.0]


def test_cells_of_a_batch_are_bounded(spark, texts):
    whole, _ = _run(spark, texts)
    bounded, share = _run(spark, texts, batch_cells=700)  # some texts alone are longer
    assert bounded == whole and share < 0.1


def test_lengths_may_come_from_a_tokenizer(spark, texts):
    made, _ = _run(spark, texts, batch_size=8, lengths=lambda column: np.zeros(len(column), int))
    assert made == _run(spark, texts)[0]


def test_cuts_take_every_row_once():
    lengths = np.array([0, 0, 1, 2, 2, 5, 9, 100])
    assert list(embed._cuts(lengths, 3, None)) == [(0, 3), (3, 6), (6, 8)]
    assert list(embed._cuts(lengths, 5, 10)) == [(0, 5), (5, 6), (6, 7), (7, 8)]
    assert list(embed._cuts(lengths[:0], 5, 10)) == []


def test_empty_tables_and_wrong_counts(spark, texts):
    assert embed.embed_text(texts.where("false"), ["id"]).collect() == []
    with pytest.raises(Exception, match="1 vectors for"):
        embed.embed_text(texts, ["id"], lambda: lambda t: np.zeros((1, 2))).collect()


def test_the_profile_reaches_spark(texts, monkeypatch):
    seen = {}

    def catch(self, func, schema, barrier=False, profile=None):
        seen["profile"] = profile
        return self

    monkeypatch.setattr(type(spread(texts)), "mapInArrow", catch)
    asked = object()
    embed.embed_text(texts, ["id"], profile=asked)
    assert seen["profile"] is asked
