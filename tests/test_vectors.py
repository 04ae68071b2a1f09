import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.functions import vectors as vec

A, B = [3.0, -4.0, 0.5], [1.0, 2.0, -2.0]


@pytest.fixture(scope="module")
def pair(spark):
    return spark.createDataFrame([(A, B, [0.0, 0.0, 0.0])],
                                 "a array<float>, b array<float>, z array<float>")


def value(df, column):
    return df.select(column).first()[0]


def test_arithmetic(pair):
    a, b, z = F.col("a"), F.col("b"), F.col("z")
    assert value(pair, vec.dot(a, b)) == np.dot(A, B)
    assert value(pair, vec.l2_distance(a, b)) == pytest.approx(np.linalg.norm(np.subtract(A, B)))
    assert value(pair, vec.cosine(a, b)) == pytest.approx(
        np.dot(A, B) / np.linalg.norm(A) / np.linalg.norm(B))
    assert value(pair, vec.cosine(a, z)) == 0.0
    assert value(pair, vec.normalize(a)) == pytest.approx(list(A / np.linalg.norm(A)))
    assert value(pair, vec.normalize(z)) == [0.0, 0.0, 0.0]
    assert value(pair, vec.normalize(F.lit(None).cast("array<float>"))) is None
    assert value(pair, vec.affine(a, 2, -1)) == [5.0, -9.0, 0.0]
    assert value(pair, vec.negate(a)) == [-3.0, 4.0, -0.5]


def test_casts(pair):
    assert value(pair, vec.to_codes(F.col("b"))) == [1, 2, -2]
    assert value(pair, vec.to_float(vec.as_double(F.col("a")))) == A
    with pytest.raises(Exception, match="(?i)overflow"):
        value(pair, vec.to_codes(F.array(F.lit(40000))))
    assert value(pair, vec.checked_dim(F.col("a"), 3)) == A
    with pytest.raises(Exception, match="width 3"):
        value(pair, vec.checked_dim(F.col("a"), 4))
