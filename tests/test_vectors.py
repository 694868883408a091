import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from spindrift.functions import vectors as V

A, B = [1.0, -2.0, 3.0], [0.5, 4.0, -1.0]


@pytest.fixture(scope="module")
def one(spark):
    return spark.createDataFrame([(A, B, [0.0, 0.0, 0.0], [1.0])], "a array<float>, b array<float>, z array<float>, s array<float>")


def value(df, column):
    return df.select(column.alias("x")).first().x


def test_kernels(one):
    a, b = F.col("a"), F.col("b")
    x, y = np.array(A), np.array(B)
    assert value(one, V.dot(a, b)) == x @ y
    assert value(one, V.square_l2(a, b)) == ((x - y) ** 2).sum()
    assert value(one, V.cosine(a, b)) == pytest.approx(x @ y / math.sqrt((x @ x) * (y @ y)))
    assert value(one, V.total(a)) == 2.0 and value(one, V.largest(a)) == 3.0 and value(one, V.smallest(a)) == -2.0
    assert value(one, V.added(a, b)) == [1.5, 2.0, 2.0] and value(one, V.added(a, 1)) == [2.0, -1.0, 4.0]
    assert value(one, V.subtracted(a, b)) == [0.5, -6.0, 4.0] and value(one, V.subtracted(a, 1)) == [0.0, -3.0, 2.0]
    assert value(one, V.minimum(a, b)) == [0.5, -2.0, -1.0] and value(one, V.scaled(a, 2)) == [2.0, -4.0, 6.0]
    assert value(one, V.part(a, 1, 2)) == [-2.0, 3.0]


def test_scores(one):
    a, b = F.col("a"), F.col("b")
    assert value(one, V.score("l2", a, a)) == 1.0 and value(one, V.score("l2", a, b)) == 1 / (1 + 52.25)
    assert value(one, V.score("dot", a, b)) == (1 - 10.5) / 2
    assert value(one, V.score("cosine", a, a)) == pytest.approx(1.0)
    assert math.isnan(value(one, V.score("cosine", a, F.col("z"))))
    with pytest.raises(ValueError):
        V.score("other", a, b)


def test_errors(one):
    with pytest.raises(Exception, match="dimensions"):
        value(one, V.dot(F.col("a"), F.col("s"), checked=True))
    with pytest.raises(Exception, match="direction"):
        value(one, V.l2_normalized(F.col("z")))
    assert np.linalg.norm(value(one, V.l2_normalized(F.col("a")))) == pytest.approx(1)


def test_sign_words(spark):
    v = np.random.default_rng(0).normal(size=130).tolist()
    v[3] = 0.0
    words = spark.createDataFrame([(v,)], "v array<double>").select(V.sign_words(F.col("v"), 130).alias("w")).first().w
    for i, word in enumerate(words):
        for j in range(min(64, 130 - 64 * i)):
            assert (word >> j) & 1 == (v[64 * i + j] > 0)


def test_hamming_and_triangles(spark):
    df = spark.createDataFrame([([-1, 5], [0, 4])], "a array<long>, b array<long>")
    assert df.select(V.hamming(F.col("a"), F.col("b")).alias("h")).first().h == 65
    pairs = [(i, j) for i in range(5) for j in range(i, 5)]
    got = spark.createDataFrame(pairs, "i int, j int").select("i", "j", V.triangle_index(F.col("j"), F.col("i"), 5).alias("t")).collect()
    assert [r.t for r in sorted(got)] == list(range(15))
