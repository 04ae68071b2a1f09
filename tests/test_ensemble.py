import hashlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_nearest import frame

from corpusloom.operators import embed, ensemble
from corpusloom.plans.submission import caption_submission

RNG = np.random.default_rng(2)


def by_hand(text, dim):
    v = np.zeros(dim)
    for w in (text or "").split():
        h = hashlib.md5(w.encode()).hexdigest()
        v[int(h[:8], 16) % dim] += 1 if int(h[8], 16) < 8 else -1
    n = np.linalg.norm(v)
    return v / n if n else v


def test_hashing_encoder(spark):
    texts = ["a b a", "  padded   words ", "", None, "tab\tand space", "x " * 700, "é ü"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, caption string")
    got = embed.embed_text(df, ["id"], lambda: embed.HashingEncoder(32), batch_size=3).collect()
    assert len(got) == len(texts)
    for i, v in got:
        assert np.allclose(v, by_hand(texts[i], 32), atol=1e-6), texts[i]


def test_an_encoder_is_made_once_per_task_and_checked(spark):
    class Lengths:
        def __call__(self, texts):
            return np.array([[len(t.as_py())] for t in texts], dtype=np.float32)

    df = spark.createDataFrame([("ab",), ("abc",)], "caption string")
    assert sorted(r[1][0] for r in embed.embed_text(df, ["caption"], Lengths).collect()) == [2, 3]
    with pytest.raises(Exception, match="vectors for"):
        embed.embed_text(df.coalesce(1), ["caption"], lambda: lambda t: np.zeros((9, 2))).collect()


@pytest.fixture(scope="module")
def tagged(spark):
    images, labels = RNG.normal(size=(30, 6)), RNG.normal(size=(24, 6))
    kinds = ["medium", "movement", "flavor"]
    kw = frame(spark, range(24), labels, "label_id",
               category=pa.array([kinds[i % 3] for i in range(24)]),
               label=pa.array([f"l{i}" for i in range(24)]))
    tags = ensemble.select_tags(frame(spark, range(30), images, "image_id"), kw)
    return images, labels, tags


def test_tags(tagged):
    images, labels, tags = tagged
    unit = lambda m: m / np.linalg.norm(m, axis=1)[:, None]
    score = unit(images) @ unit(labels).T
    got = tags.toPandas()
    assert len(got) == 30 * 5
    for c, (kind, k) in enumerate([("medium", 1), ("movement", 1), ("flavor", 3)]):
        own = np.arange(c, 24, 3)
        for i in range(30):
            best = own[np.argsort(-score[i, own])[:k]]
            rows = got[(got["image_id"] == i) & (got["category"] == kind)].sort_values("rank")
            assert rows["label_id"].tolist() == best.tolist()
            assert rows["label"].tolist() == [f"l{b}" for b in best]


def test_suffixes_by_image_and_tiled(spark, tagged):
    _, _, tags = tagged
    suffix = ensemble.suffixes(tags)
    table = {r[0]: r[1] for r in suffix.collect()}
    assert len(table) == 30 and table[0].endswith(", fine details, masterpiece")
    assert table[0].count(", ") == 7
    prompts = spark.range(90).select(
        F.floor(F.col("id") / 3).alias("image_id"), (F.col("id") % 3).alias("seq"),
        F.lit("p").alias("text"))
    own = ensemble.attach_suffix(prompts, suffix).collect()
    assert all(r["text"] == "p" + table[r["image_id"]] for r in own) and len(own) == 90
    two = prompts.withColumn("model", F.explode(F.array(F.lit("A"), F.lit("B"))))
    tiled = ensemble.attach_suffix(two, suffix, "tiled").collect()
    assert len(tiled) == 180
    assert all(r["text"] == "p" + table[(r["image_id"] * 3 + r["seq"]) % 30] for r in tiled)
    with pytest.raises(Exception, match="no suffix for image"):
        ensemble.attach_suffix(prompts, suffix.where("image_id <> 4")).collect()
    with pytest.raises(ValueError):
        ensemble.attach_suffix(prompts, suffix, "random")


def test_quotas_name_their_categories(spark):
    images = frame(spark, range(3), RNG.normal(size=(3, 4)), "image_id")
    labels = [(c, i, f"{c}{i}", RNG.normal(size=4).tolist()) for i, c in enumerate("mmvvffffxxxx")]
    kw = spark.createDataFrame(labels, "category string, label_id long, label string, embedding array<double>")
    got = ensemble.select_tags(images, kw, quotas={"m": 1, "f": 3, "x": 2}).groupBy("category").count()
    assert {r[0]: r[1] for r in got.collect()} == {"m": 3, "f": 9, "x": 6, "v": 3}


def test_an_image_without_a_category_has_a_suffix(spark):
    tags = spark.createDataFrame([(1, "flavor", 1, "warm")], "image_id long, category string, rank int, label string")
    assert ensemble.suffixes(tags).first()["suffix"] == ", , , warm, fine details, masterpiece"


def test_pool_and_long_form(spark):
    x = RNG.normal(size=(40, 5))
    df = frame(spark, range(40), x, "row").withColumn("image_id", F.col("row") % 3)
    pooled = {r[0]: r[1] for r in ensemble.mean_pool(df, ["image_id"]).collect()}
    for i in range(3):
        assert np.allclose(pooled[i], x[i::3].mean(axis=0))
    long_form = ensemble.submission_long(ensemble.mean_pool(df, ["image_id"])).collect()
    assert {r[0] for r in long_form} == {f"{i}_{e}" for i in range(3) for e in range(5)}


def test_weighted_mean(spark):
    df = spark.createDataFrame([(1.0, 3), (5.0, 1)], "loss double, n int")
    assert ensemble.weighted_mean(df, "loss", "n").first()[0] == 2.0


def test_whole_submission(spark):
    captions = spark.createDataFrame([
        (1, "m1", 0, "<start_of_text>there is a cat .<end_of_text>junk"), (1, "m2", 0, "this is a dog"),
        (2, "m1", 0, "a boat")], "image_id int, model string, seq int, text string")
    suffix = spark.createDataFrame([(1, ", oil"), (2, ", ink")], "image_id int, suffix string")
    got = {r[0]: r[1] for r in caption_submission(
        captions, suffix, lambda: embed.HashingEncoder(16)).collect()}
    expected = (by_hand("a cat, oil", 16) + by_hand("a dog, oil", 16)) / 2
    assert np.allclose([got[f"1_{e}"] for e in range(16)], expected, atol=1e-6)
    assert np.allclose([got[f"2_{e}"] for e in range(16)], by_hand("a boat, ink", 16), atol=1e-6)
