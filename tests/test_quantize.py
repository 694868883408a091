import numpy as np
import pytest
from pyspark.sql import functions as F

from spindrift.operators import kmeans, nvq, quantize, search
from spindrift.plans import options

RNG = np.random.default_rng(3)
POINTS = RNG.normal(size=(400, 10))
POINTS /= np.linalg.norm(POINTS, axis=1, keepdims=True)


@pytest.fixture(scope="module")
def base(spark):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(POINTS)], "vec_id long, embedding array<float>").repartition(3)


def test_kmeans():
    blobs = np.concatenate([RNG.normal(c, 0.05, size=(50, 2)) for c in ((0, 0), (5, 5), (0, 5))])
    found = kmeans.fit(blobs, 3, seed=1)
    assert sorted(map(tuple, np.rint(found).astype(int).tolist())) == [(0, 0), (0, 5), (5, 5)]
    assert (kmeans.fit(blobs, 3, seed=1) == found).all()
    same = kmeans.fit(np.ones((8, 2)), 4)
    assert (same == 1).all()
    with pytest.raises(ValueError):
        kmeans.fit(np.ones((2, 2)), 3)


def test_anisotropic_weighs_errors_along_the_vector():
    assert kmeans.parallel_cost(-1, 10) == 1.0 and kmeans.parallel_cost(0.2, 100) == pytest.approx(0.04 * 99 / 0.96)
    c = kmeans.anisotropic_centroid(POINTS, 1.0)
    assert np.allclose(c, POINTS.mean(axis=0))
    w = 5.0
    best = kmeans.anisotropic_centroid(POINTS[:30], w)
    least = kmeans.anisotropic_losses(POINTS[:30], best[None], w).sum()
    for _ in range(20):
        assert least <= kmeans.anisotropic_losses(POINTS[:30], (best + RNG.normal(0, 0.05, 10))[None], w).sum()


def test_product_quantizer():
    assert quantize.subspaces(10, 4) == [(0, 3), (3, 3), (6, 2), (8, 2)]
    exact = quantize.ProductQuantizer.from_vectors(POINTS[:20], 3)
    assert np.allclose(exact.decode(exact.encode(POINTS[:20])), POINTS[:20])
    errors = [quantize.ProductQuantizer.train(POINTS, m, 16).errors(POINTS).mean() for m in (1, 2, 5)]
    assert errors[0] > errors[1] > errors[2]
    codec = quantize.ProductQuantizer.train(POINTS, 5, 16, center=True, rounds=1)
    assert codec.refine(POINTS, 5).errors(POINTS).mean() <= codec.errors(POINTS).mean() and np.allclose(codec.mean(), POINTS.mean(axis=0))
    assert (codec.encode(POINTS) == quantize.ProductQuantizer.train(POINTS, 5, 16, center=True, rounds=1).encode(POINTS)).all()
    assert codec.sizes() == {"vector": 40, "code": 5, "codec": 4 * 10 * 16 + 40}
    tie = quantize.ProductQuantizer(1, [np.array([[1.0], [-1.0]])])
    assert tie.encode(np.array([[0.0]])).tolist() == [[0]]
    for bad in (lambda: quantize.ProductQuantizer.train(POINTS, 2, 257), lambda: quantize.subspaces(4, 5), lambda: codec.table(POINTS[0], "cosine")):
        with pytest.raises(ValueError):
            bad()


def test_errors_are_alike_on_new_vectors():
    codec = quantize.ProductQuantizer.train(POINTS[:300], 5, 16)
    assert codec.errors(POINTS[300:]).mean() / codec.errors(POINTS[:300]).mean() < 1.5
    flat = nvq.NonUniformQuantizer.train(POINTS[:300], 2)
    assert flat.errors(POINTS[300:]).mean() / flat.errors(POINTS[:300]).mean() == pytest.approx(1, abs=0.5)


def test_weighted_encoding_lowers_its_loss():
    codec = quantize.ProductQuantizer.train(POINTS, 5, 16, threshold=0.5)
    plain = quantize.ProductQuantizer(10, codec.codebooks)

    def loss(codes):
        away = POINTS - plain.decode(codes)
        along = (away * POINTS).sum(axis=1)
        return ((away**2).sum(axis=1) + (codec.weight - 1) * along**2).sum()

    assert codec.weight > 1 and loss(codec.encode(POINTS)) <= loss(plain.encode(POINTS))


@pytest.mark.parametrize("metric", ["l2", "dot", "cosine"])
def test_scores_from_tables_are_scores_of_decoded_vectors(base, metric):
    codec = quantize.ProductQuantizer.train(POINTS, 5, 16, center=metric == "l2")
    codes = quantize.pq_encode(base, codec)
    got = quantize.pq_search(codes, base.filter("vec_id < 4"), codec, 8, metric).collect()
    decoded = codec.decode(codec.encode(POINTS.astype(np.float32).astype(float)))
    scores = search.block_scores(metric, POINTS[:4].astype(np.float32).astype(float), decoded)
    assert len(got) == 32
    for r in got:
        assert r.score == pytest.approx(scores[r.query_id, r.vec_id], abs=1e-6)


@pytest.mark.parametrize("metric", ["l2", "dot", "cosine"])
def test_code_to_code_scores(base, metric):
    codec = quantize.ProductQuantizer.train(POINTS, 5, 8)
    codes = quantize.pq_encode(base.filter("vec_id < 12"), codec)
    decoded = codec.decode(codec.encode(POINTS[:12].astype(np.float32).astype(float)))
    scores = search.block_scores(metric, decoded, decoded)
    got = quantize.pq_pair_scores(codes, codes, codec, metric).collect()
    assert len(got) == 66 and all(r.score == pytest.approx(scores[r.a, r.b], abs=1e-6) for r in got)


def test_decoding_in_columns(base):
    codec = quantize.ProductQuantizer.train(POINTS, 3, 8, center=True)
    for r in quantize.pq_decode(quantize.pq_encode(base, codec), codec).limit(20).collect():
        assert np.allclose(r.decoded, codec.decode(codec.encode(POINTS[r.vec_id : r.vec_id + 1].astype(np.float32).astype(float)))[0])


def test_samples(base, spark):
    assert (quantize.sample(base, 50) == quantize.sample(base.repartition(2), 50)).all()
    small, large = base.filter("vec_id < 40"), base.filter("vec_id >= 40")
    got = quantize.balanced_sample([small, large], 100, least=30)
    assert got.count() == 100 and got.filter("vec_id < 40").count() == 30


def test_binary(base):
    codes = quantize.bq_encode(base, 10)
    got = quantize.bq_search(codes, codes.filter("vec_id < 3"), 10, 5).collect()
    signs = POINTS > 0
    for q in range(3):
        away = sorted(((signs[q] != signs[i]).sum(), i) for i in range(400) if i != q)[:5]
        assert [(r.vec_id, r.score) for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q] == [(i, pytest.approx(1 - d / 10)) for d, i in away]
    error = base.filter("vec_id = 0").select(quantize.bq_error(F.col("embedding")).alias("e")).first().e
    assert error == pytest.approx(((POINTS[0] - signs[0]) ** 2).mean(), abs=1e-6)


def test_non_uniform(base):
    x = np.linspace(-3, 3, 101)
    assert np.allclose(nvq.logit(nvq.logistic(x, 2.0), 2.0), x, atol=1e-9)
    skewed = RNG.laplace(size=(60, 64)) * 0.1
    codec = nvq.NonUniformQuantizer.train(skewed, 2)
    assert (codec.loss_ratio(skewed) >= 0.99).all() and codec.loss_ratio(skewed).mean() > 1.2
    assert np.abs(codec.decode(codec.encode(skewed)) - skewed).max() < 0.05
    flat = np.ones((3, 4))
    assert np.allclose(nvq.NonUniformQuantizer(np.zeros(4), 1).decode(nvq.NonUniformQuantizer(np.zeros(4), 1).encode(flat)), flat)
    codec = nvq.NonUniformQuantizer.train(POINTS, 2)
    encoded = nvq.nvq_encode(base, codec)
    assert encoded.agg(F.max("error")).first()[0] < 1e-4
    for r in nvq.nvq_decode(encoded, codec).limit(10).collect():
        assert np.abs(np.array(r.embedding) - POINTS[r.vec_id]).max() < 0.02


def test_options():
    assert options.grid(a=[1, 2], b=3) == [{"a": 1, "b": 3}, {"a": 2, "b": 3}] and options.rerank_k(10, 2.55) == 25
    assert options.Compression("product", m_factor=8).parts(64) == 8 and options.Compression("product", m=4).parts(64) == 4
    assert options.Compression("product", m=4).centered("l2") and not options.Compression("product", m=4).centered("dot")
    for bad in (dict(degree=0), dict(overflow=0.9), dict(alpha=0), dict(beam=0), dict(degree=(8, 4), hierarchy=False)):
        with pytest.raises(ValueError):
            options.BuildOptions(**bad)


@pytest.mark.parametrize("metric", ["l2", "dot", "cosine"])
def test_scores_of_non_uniform_codes_are_those_of_decoded_vectors(base, metric):
    codec = nvq.NonUniformQuantizer.train(POINTS, 2)
    parts = codec.encode(POINTS)
    assert np.allclose(codec.scores(POINTS[:7], parts, metric), search.block_scores(metric, POINTS[:7], codec.decode(parts)))
    got = nvq.nvq_search(nvq.nvq_encode(base, codec), base.filter("vec_id < 4"), codec, 3, metric).collect()
    want = search.search(base, base.filter("vec_id < 4"), 3, metric).collect()
    assert len(got) == 12 and len({(r.query_id, r.vec_id) for r in got} & {(r.query_id, r.vec_id) for r in want}) >= 11
