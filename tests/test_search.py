import numpy as np
import pytest
from pyspark.sql import functions as F

from spindrift.operators import metrics, search, segments

SCHEMA = "vec_id long, embedding array<float>, label int"


def rows(n=120, dim=6, seed=0):
    rng = np.random.default_rng(seed)
    v = (rng.normal(size=(n, dim)) * rng.uniform(0.5, 3, size=(n, 1))).astype(np.float32)
    return [(i, v[i].tolist(), i % 4) for i in range(n)]


@pytest.fixture(scope="module")
def base(spark):
    extra = [(200, rows()[0][1], 0), (201, rows()[0][1], 1), (202, [0.0] * 6, 2), (203, None, 3)]
    return spark.createDataFrame(rows() + extra, SCHEMA).repartition(5)


def brute(data, qs, k, metric, ok=lambda r: True, t=None, skip=0):
    out = []
    for qi, q in qs:
        found = []
        for i, v, *rest in data:
            if v is None or i == qi or not ok((i, *rest)):
                continue
            a, b = np.array(q, dtype=float), np.array(v, dtype=float)
            with np.errstate(invalid="ignore"):
                s = {"l2": 1 / (1 + ((a - b) ** 2).sum()), "dot": (1 + a @ b) / 2, "cosine": (1 + a @ b / np.sqrt((a @ a) * (b @ b))) / 2}[metric]
            if not np.isnan(s) and (t is None or s >= t):
                found.append((-round(float(s), 9), i))
        out += [(qi, n, i) for n, (_, i) in enumerate(sorted(found), 1)][0:] if k is None else [(qi, n, i) for n, (_, i) in enumerate(sorted(found), 1) if skip < n <= skip + k]
    return sorted(out)


def ids(df):
    return sorted((r.query_id, r["rank"], r.vec_id) for r in df.collect())


@pytest.mark.parametrize("metric", ["l2", "dot", "cosine"])
def test_equals_brute_force(base, metric):
    data = [tuple(r) for r in base.collect()]
    q = base.filter("vec_id < 8")
    qs = [(i, v) for i, v, _ in data if i < 8]
    assert ids(search.search(base, q, 7, metric)) == brute(data, qs, 7, metric)
    assert ids(search.search(base, q, 7, metric, block_bytes=100)) == brute(data, qs, 7, metric)
    assert ids(search.search(base, q, 5, metric, skip=5)) == brute(data, qs, 5, metric, skip=5)
    assert ids(search.search(base, q, 1000, metric)) == brute(data, qs, 1000, metric)


def test_filters_thresholds_and_pages(base):
    data = [tuple(r) for r in base.collect()]
    q = base.filter("vec_id < 5")
    qs = [(i, v) for i, v, _ in data if i < 5]
    assert ids(search.search(base, q, 6, accept=F.col("label") == 1)) == brute(data, qs, 6, "cosine", lambda r: r[1] == 1)
    some = base.filter("vec_id % 3 = 0").select("vec_id")
    assert ids(search.search(base, q, 6, accept=some)) == brute(data, qs, 6, "cosine", lambda r: r[0] % 3 == 0)
    assert ids(search.search(base, q, 6, deleted=some)) == brute(data, qs, 6, "cosine", lambda r: r[0] % 3 != 0)
    assert ids(search.search(base, q, None, threshold=0.8)) == brute(data, qs, None, "cosine", t=0.8)
    assert ids(search.search(base, q, 6, accept=some.filter("false"))) == []
    assert ids(search.search(base, q.filter("false"), 6)) == []
    first, second = ids(search.search(base, q, 6)), ids(search.search(base, q, 6, skip=6))
    assert not {(a, c) for a, _, c in first} & {(a, c) for a, _, c in second}


def test_ties_go_by_id(base):
    got = search.search(base, base.filter("vec_id = 0"), 2, "l2").collect()
    assert [r.vec_id for r in sorted(got, key=lambda r: r["rank"])] == [200, 201] and all(r.score == 1.0 for r in got)


def test_bad_calls(base, spark):
    q = base.filter("vec_id < 2")
    for call in (lambda: search.search(base, q, 0), lambda: search.search(base, q, None), lambda: search.search(base, q, 3, "other"), lambda: search.two_pass(base, q, 5, 4, None)):
        with pytest.raises(ValueError):
            call()
    short = spark.createDataFrame([(1, [1.0, 2.0])], "vec_id long, embedding array<float>")
    with pytest.raises(Exception, match="dimensions"):
        search.search(short, q, 3).collect()


def test_segments_give_the_same_answer(base):
    q = base.filter("vec_id < 6")
    parts = [search.search(base.filter(F.col("vec_id") % 3 == i), q, 5) for i in range(3)]
    assert ids(search.merge(parts, 5)) == ids(search.search(base, q, 5))


def test_similar_pairs(base):
    got = {(r.a, r.b) for r in search.similar_pairs(base, 0.9).collect()}
    data = [(r.vec_id, r.embedding) for r in base.collect() if r.embedding is not None]
    assert got == {(q, i) for q, _, i in brute(data, data, None, "cosine", t=0.9) if q < i}


def test_rerank_floor_and_worst(base):
    q = base.filter("vec_id < 3")
    near = search.search(base, q, 20, "dot")
    got = search.rerank(near, base, q, 5, "dot", floor=1e9).collect()
    assert sorted(r.query_id for r in got) == [0, 1, 2] and all(r.worst_approx == float("inf") for r in got)
    full = search.rerank(near, base, q, 5, "dot")
    assert ids(full.drop("approx_score", "worst_approx")) == ids(search.search(base, q, 5, "dot"))
    assert all(r.worst_approx <= r.approx_score for r in full.collect())


def test_accuracy(spark):
    truth = spark.createDataFrame([(q, r, 10 * q + r) for q in (1, 2) for r in (1, 2, 3)], "query_id long, rank int, vec_id long")
    found = spark.createDataFrame([(1, 1, 11), (1, 2, 99), (1, 3, 12), (2, 1, 98), (2, 2, 21), (2, 3, 97)], "query_id long, rank int, vec_id long")
    assert metrics.recall(truth, found, 3, 3).first().recall == 3 / 6
    ap = {r.query_id: r.ap for r in metrics.average_precision(truth, found, 3).collect()}
    assert ap == {1: pytest.approx((1 + 2 / 3) / 3), 2: pytest.approx(0.5 / 3)}
    assert metrics.mean_average_precision(truth, found, 3).first().map == pytest.approx(sum(ap.values()) / 2)
    metrics.check(truth, found, 3, 3)
    for bad in (found.filter("rank < 3"), found.filter("query_id = 1"), found.withColumn("vec_id", F.when(F.col("rank") > 1, F.col("vec_id"))), found.withColumn("vec_id", F.lit(7))):
        with pytest.raises(ValueError):
            metrics.check(truth, bad, 3, 3)
    with pytest.raises(ValueError):
        metrics.recall(truth, found, 3, 2)


def test_speed_statistics(spark):
    df = spark.createDataFrame([(float(i), 100, 2.0 + i % 2) for i in range(1, 2001)], "ms double, queries long, seconds double")
    r = metrics.latency(df, "ms").first()
    assert (r["mean"], r.p999) == (1000.5, 1998.0) and r["std"] == pytest.approx(np.std(np.arange(1, 2001)))
    t = metrics.throughput(df).first()
    assert t.max_qps == 50.0 and t.average_qps == pytest.approx((50 + 100 / 3) / 2)


def test_partitions(spark):
    assert segments.bounds(110, 4, "FIBONACCI") == [10, 30, 60, 110]
    assert segments.bounds(10, 3, "UNIFORM") == [3, 6, 10] and segments.bounds(150, 4, "LOG2N") == [10, 30, 70, 150]
    assert segments.bounds(1000, 3, "TIERED_10_90") == [50, 100, 1000] and segments.bounds(1000, 2, "TIERED_1_99") == [10, 1000]
    with pytest.raises(ValueError):
        segments.bounds(3, 5, "UNIFORM")
    with pytest.raises(ValueError):
        segments.bounds(3, 1, "OTHER")
    df = spark.range(0, 300, 3).withColumnRenamed("id", "vec_id").repartition(7)
    assert [r["ord"] for r in segments.numbered(df).orderBy("vec_id").collect()] == list(range(100))


def test_compaction(spark, base):
    a, b = base.filter("label < 2"), base.filter("label >= 2")
    gone = spark.createDataFrame([(0, 4), (1, 2)], "source int, vec_id long")
    got = segments.compact([a, b], gone).orderBy("vec_id").collect()
    want = sorted([(0, r.vec_id) for r in a.collect() if r.vec_id != 4] + [(1, r.vec_id) for r in b.collect() if r.vec_id != 2])
    assert [(r.source, r.old_id) for r in got] == want and [r.vec_id for r in got] == list(range(len(want)))
    ok = frozenset({"embedding"})
    segments.validate([a, b], [6, 6], [ok, ok])
    for bad in (([a], [6], [ok]), ([a, b], [6], [ok, ok]), ([a, b], [6, 7], [ok, ok]), ([a, b], [6, 6], [ok, frozenset()]), ([a, b], [6, 6], [frozenset(), frozenset()])):
        with pytest.raises(ValueError):
            segments.validate(*bad)


def test_all_rows_in_blocks(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(size=6)]) for i in range(90)] + [(200, [0.0] * 6), (201, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)
    for metric in ("cosine", "l2", "dot"):
        want = {tuple(r) for r in search.search(df, df, 3, metric).collect()}
        assert {tuple(r) for r in search.nearest_of_all(df, 3, metric, part=20).collect()} == want
        near = {(r.query_id, r.vec_id, r.score) for r in search.search(df, df, None, metric, threshold=0.6).collect() if r.query_id < r.vec_id}
        assert {tuple(r) for r in search.similar_pairs(df, 0.6, metric, part=20).collect()} == near and near
    assert search.similar_pairs(df.filter("false"), 0.6).count() == 0


def test_scores_are_taken_in_bounded_tiles(spark):
    df = spark.createDataFrame([(i, [float(i % 7), 1.0]) for i in range(1500)], "vec_id long, embedding array<float>").repartition(1)

    def rough(q, rows):
        if q.shape[0] > search.ASKING or q.shape[0] * rows.shape[0] > max(search.SCORES, 16 * search.ASKING):
            raise ValueError("too many at once")
        return q @ rows.T

    blocks = lambda: search.query_blocks(df, "vec_id", "embedding", 1 << 30)
    read = lambda batch: search.matrix(batch.column("embedding"))
    assert search.scan(df, blocks(), read, rough).count() == 1500 * 1499
    best = search.scan(df, blocks(), read, rough, None, 2)
    assert best.count() == 3000 and best.filter("query_id = 3").orderBy("vec_id").collect()[0].vec_id == 6


@pytest.mark.parametrize("metric", ["cosine", "l2", "dot"])
def test_blocks_of_several_tiles_ask_each_other_by_one_product(spark, monkeypatch, metric):
    rng = np.random.default_rng(3)
    v = np.concatenate([rng.normal(size=(60, 5)), np.zeros((2, 5)), 1e-60 * np.ones((1, 5))]).astype(np.float32)
    v = np.concatenate([v, v[:20]])  # ties
    seen = []
    whole = search.roughly

    def counted(metric, rows):
        scores, margin = whole(metric, rows)
        return (lambda a, b: seen.append((len(a), len(b))) or scores(a, b)), margin

    monkeypatch.setattr(search, "TILE", 8)
    monkeypatch.setattr(search, "roughly", counted)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>").repartition(3)
    table = {}
    monkeypatch.setattr(search, "dealt", lambda *a: type("Dealt", (), {"groupBy": lambda self, *c: self, "applyInArrow": lambda self, f, schema: table.update(f=f)})())
    for k in (1, 4, 200):
        search.all_pairs(df, k, None, metric)
        import pyarrow as pa

        rows = df.toPandas()
        own = (rows.vec_id % 2).astype("int32")
        got = table["f"](pa.table({"i": pa.array(np.zeros(len(rows), np.int32)), "j": pa.array(np.ones(len(rows), np.int32)), "own": pa.array(own), "vec_id": pa.array(rows.vec_id), "embedding": pa.array(rows.embedding.tolist(), pa.list_(pa.float32()))})).to_pandas()
        x = np.stack(rows.embedding).astype(float)
        order = np.argsort(rows.vec_id)
        x = x[order]
        for a in range(len(x)):
            others = np.array([b for b in range(len(x)) if b % 2 != a % 2])
            s = search.exact_scores(metric, np.repeat(x[a][None], len(others), axis=0), x[others])
            want = sorted((-t, int(b)) for t, b in zip(s, others) if not np.isnan(t))[:k]
            mine = got[got.query_id == a]
            assert sorted(zip(-mine.score, mine.vec_id)) == want
    assert max(map(max, seen)) <= 8 and sum(a * b for a, b in seen) == 3 * (len(v) // 2) * (len(v) - len(v) // 2)
