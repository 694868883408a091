import heapq
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from spindrift.operators import graph, metrics, quantize, search
from spindrift.plans.options import BuildOptions
from spindrift.plans.session import VectorSession

OPTIONS = BuildOptions(degree=12, beam=50)
RNG = np.random.default_rng(11)
POINTS = RNG.normal(size=(300, 8))


def truth(q, k, metric="cosine", ok=None):
    s = search.block_scores(metric, q[None], POINTS)[0]
    order = [i for i in np.lexsort((np.arange(300), -s)) if ok is None or ok(i)]
    return order[:k]


@pytest.fixture(scope="module")
def built():
    return graph.Graph.build(np.arange(300), POINTS, "cosine", OPTIONS)


def overlap(g, k=5, **options):
    hits = 0
    for q in RNG.normal(size=(60, 8)):
        found = {n for _, n in g.search(q, k, rerank_k=50, **options).results}
        hits += len(found & set(truth(q, k, ok=options.get("accept"))))
    return hits / (60 * k)


def test_recall_and_filter(built):
    assert overlap(built) > 0.95
    assert overlap(built, accept=lambda n: n % 2 == 0) > 0.95
    every = [n for n in range(300) if n % 60 == 0]
    assert {n for _, n in built.search(POINTS[3], 5, rerank_k=300, accept=lambda n: n % 60 == 0).results} == set(every)


def test_degrees_and_repeatability(built):
    for level, adjacent in enumerate(built.layers):
        assert all(len(near) <= OPTIONS.layer_degree(level) and n not in near for n, near in adjacent.items())
    again = graph.Graph.build(np.arange(300)[::-1], POINTS[::-1], "cosine", OPTIONS)
    assert again.layers == built.layers and again.entry == built.entry


def test_threshold(built):
    found = built.search(POINTS[0], 300, threshold=0.9).results
    assert all(s >= 0.9 for s, _ in found)
    s = search.block_scores("cosine", POINTS[:1], POINTS)[0]
    assert len(found) >= 0.9 * (s >= 0.9).sum()


def test_counters_and_errors(built):
    r = built.search(POINTS[0], 5)
    assert 5 <= r.visited <= 300 and 0 < r.expanded_base <= r.expanded
    with pytest.raises(ValueError):
        built.search(POINTS[0], 5, rerank_k=4)
    assert graph.Graph(POINTS[:0], np.arange(0), "cosine", OPTIONS).search(POINTS[0], 3).results == []


def test_deletion():
    g = graph.Graph.build(np.arange(100), POINTS[:100], "l2", OPTIONS)
    gone = set(range(0, 100, 3)) | {g.entry}
    g.delete(gone)
    assert not gone & {n for _, n in g.search(POINTS[0], 50).results}
    g.remove_deleted()
    assert not gone & g.layers[0].keys() and not any(gone & set(near) for a in g.layers for near in a.values()) and g.entry not in gone
    assert len({n for _, n in g.search(POINTS[1], 100, rerank_k=100).results}) == 100 - len(gone)
    g.delete(set(g.layers[0]))
    g.remove_deleted()
    assert g.entry is None and g.search(POINTS[0], 3).results == []


def test_diverse_neighbours():
    flat = graph.Graph(np.array([[0.0, 0.0], [1.0, 0.0], [1.1, 0.0], [0.0, 1.5]]), np.arange(4), "l2", BuildOptions(degree=2, alpha=1.0))
    s = flat.scores(flat.vectors[0], [1, 2, 3])
    assert flat.diverse(flat.vectors[0], list(zip(s.tolist(), [1, 2, 3])), 2) == [1, 3]


def test_tables(spark):
    df = graph.with_segment(spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(POINTS)], "vec_id long, embedding array<float>"), 3).cache()
    edges = graph.build(df, "cosine", OPTIONS).cache()
    q = df.filter("vec_id < 20").select("vec_id", "embedding")
    found = search.ranked(graph.graph_search(edges, df, q, 5, rerank_k=30, options=OPTIONS), 5)
    assert metrics.recall(search.search(df, q, 5), found, 5, 5).first().recall > 0.95
    filtered = graph.graph_search(edges, df, q, 5, rerank_k=30, accept=F.col("vec_id") % 2 == 1, options=OPTIONS)
    assert filtered.filter("vec_id % 2 = 0").count() == 0
    stats = {r.level: r for r in graph.stats(edges).collect()}
    assert stats[0].nodes == 300 and stats[0].max_degree <= 12
    fixed = graph.repair(edges, df.filter("vec_id < 50"), df, options=OPTIONS)
    assert fixed.filter("level = 0").count() == 250 and fixed.filter(F.exists("neighbors", lambda x: x < 50)).count() == 0
    other = graph.rescored(edges, df, "l2")
    assert other.count() == edges.count() and other.filter(F.size("neighbors") != F.size("scores")).count() == 0


def test_session(spark):
    s = VectorSession(spark).create(8, "cosine", OPTIONS, segments=2)
    s.write([(i, v.tolist()) for i, v in enumerate(POINTS[:120])])
    q = spark.createDataFrame([(1000, [float(x) for x in POINTS[5]])], "vec_id long, embedding array<float>")
    exact = [r.vec_id for r in s.search(q, 5).orderBy("rank").collect()]
    s.optimize()
    assert [r.vec_id for r in s.search(q, 5, overquery=8).orderBy("rank").collect()] == exact and exact[0] == 5
    s.write([(500, POINTS[5].tolist())])
    s.delete(spark.createDataFrame([(5,)], "vec_id long"))
    assert [r.vec_id for r in s.search(q, 2, overquery=20).orderBy("rank").collect()] == [500, exact[1]]
    assert s.memory()["rows"] == 120 and s.memory()["edges"] > 0 and s.quantizer(2, 16).m == 2
    with pytest.raises(Exception, match="dimensions"):
        s.write([(1, [1.0])]) or s.search(q, 1).collect()


def test_pruning_equals_its_definition():
    rng = np.random.default_rng(2)
    for alpha in (1.0, 1.2):
        own, points = rng.random((40, 12)), rng.normal(size=(40, 12, 3))
        own.sort(axis=1)
        between = ((points[:, :, None] - points[:, None]) ** 2).sum(axis=3)
        got = graph.pruned(own, between, 5, alpha)
        for row in range(40):
            chosen = []
            for slack in sorted({1.0, alpha}):
                for i in range(12):  # nearest first
                    if len(chosen) < 5 and i not in chosen and all(slack * between[row, c, i] > own[row, i] for c in chosen):
                        chosen.append(i)
            assert [i for i in got[row] if i >= 0] == chosen


def test_walks_are_taken_up_again(built):
    q = POINTS[7]
    first = built.search(q, 5, rerank_k=20)
    second = built.resume(q, first, 5)
    both = [n for _, n in first.results + second.results]
    assert len(set(both)) == 10 and len(set(both) & set(truth(q, 10))) >= 9
    rest = built.resume(q, second, 300)
    assert len(set(both) | {n for _, n in rest.results}) == 300 and not set(both) & {n for _, n in rest.results}


def test_search_by_codes():
    codec = quantize.ProductQuantizer.train(POINTS, 4, 32)
    g = graph.Graph.build(np.arange(300), POINTS, "cosine", OPTIONS)
    g.codes = codec.encode(POINTS).astype(np.int64)
    hits = 0
    for q in RNG.normal(size=(40, 8)):
        found = g.search(q, 5, rerank_k=60, codec=codec)
        s = g.scores(q, [n for _, n in found.results])
        assert [x for x, _ in found.results] == pytest.approx(sorted(s, reverse=True)) and found.reranked == 60 and found.worst_approximate < 1.1
        hits += len({n for _, n in found.results} & set(truth(q, 5)))
        high = g.search(q, 5, rerank_k=60, codec=codec, floor=2.0)
        assert high.reranked == 1 and len(high.results) == 1
    assert hits / 200 > 0.9


def test_merged_graphs(built):
    thirds = [np.arange(i, 300, 3) for i in range(3)]
    parts = [graph.Graph.build(t, POINTS[t], "cosine", OPTIONS) for t in thirds]
    parts[0].delete({0, 5, 9})
    gone = {int(parts[0].ids[n]) for n in (0, 5, 9)}
    merged = graph.Graph.merge(parts, OPTIONS).check()
    assert set(merged.ids) == set(range(300)) - gone and len(merged.reached(0)) == 297
    assert all(len(near) <= 12 and len(set(near)) == len(near) for near in merged.layers[0].values())
    hits = 0
    for q in RNG.normal(size=(60, 8)):
        found = {int(merged.ids[n]) for _, n in merged.search(q, 5, rerank_k=50).results}
        hits += len(found & set(truth(q, 5, ok=lambda i: i not in gone)))
    assert hits / 300 > 0.95
    with pytest.raises(ValueError, match="several"):
        graph.Graph.merge([parts[1], parts[1]], OPTIONS)


def test_insertion(built):
    g = graph.Graph.build(np.arange(200), POINTS[:200], "cosine", OPTIONS)
    for i in range(200, 300):
        assert g.add(i, POINTS[i]) == i
    g.finish().check()
    assert overlap(g) > 0.95
    one = graph.Graph(POINTS[:0], np.arange(0), "cosine", OPTIONS)
    one.add(3, POINTS[3])
    assert one.check().search(POINTS[0], 2).results[0][1] == 0
    g.entry = None
    with pytest.raises(ValueError, match="entry"):
        g.check()


def test_compacted_tables(spark):
    df = graph.with_segment(spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(POINTS)], "vec_id long, embedding array<float>"), 4).cache()
    edges = graph.build(df, "cosine", OPTIONS)
    gone = df.filter("vec_id < 30").select("vec_id")
    merged = graph.compact(edges, df, 2, gone, options=OPTIONS).cache()
    assert merged.select("segment").distinct().count() == 2 and merged.filter("level = 0").count() == 270 and merged.filter("entry").count() == 2
    live = df.filter("vec_id >= 30").withColumn("segment", F.pmod("segment", F.lit(2)).cast("int"))
    q = df.filter("vec_id % 15 = 0").select("vec_id", "embedding")
    found = search.ranked(graph.graph_search(merged, live, q, 5, rerank_k=30, options=OPTIONS), 5)
    assert metrics.recall(search.search(live, q, 5), found, 5, 5).first().recall > 0.95
    codec = quantize.ProductQuantizer.train(POINTS, 4, 32)
    fused = graph.with_codes(merged, quantize.pq_encode(df, codec))
    by_codes = search.ranked(graph.graph_search(fused, live, q, 5, rerank_k=60, options=OPTIONS, codec=codec), 5)
    assert metrics.recall(search.search(live, q, 5), by_codes, 5, 5).first().recall > 0.9
    with pytest.raises(ValueError, match="codes"):
        graph.graph_search(merged, live, q, 5, codec=codec)


def test_timed_runs(spark):
    runs = metrics.timed(spark, {"a": lambda: spark.range(5), "b": lambda: spark.range(9)}, 7, repeats=2, warm_up=0)
    assert runs.count() == 4 and runs.filter("seconds <= 0 or queries <> 7").count() == 0 and metrics.throughput(runs, ["name"]).count() == 2


@pytest.mark.parametrize("metric", ["cosine", "l2", "dot"])
def test_complete_search_of_many_equal_vectors_equals_exact_search(spark, metric):
    rng = np.random.default_rng(8)
    v = rng.normal(size=(12, 7)).astype(np.float32)
    rows = [(i, [float(x) for x in v[i % 12]], 0) for i in range(900)] + [(901, [0.0] * 7, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    base = graph.with_segment(df, 2)
    q = df.filter("vec_id % 50 = 0").select("vec_id", "embedding")
    edges = graph.build(base, metric, BuildOptions(degree=4, beam=8))
    found = graph.graph_search(edges, base, q, 10, metric, options=BuildOptions(degree=4, beam=8), complete=True)
    keys = lambda x: {(r.query_id, r["rank"], r.vec_id, r.score) for r in x.collect()}
    assert keys(search.ranked(found, 10)) == keys(search.search(df, q, 10, metric))
    some = graph.graph_search(edges, base, q, 10, metric, accept=F.col("vec_id") % 3 == 1, options=BuildOptions(degree=4, beam=8), complete=True)
    assert keys(search.ranked(some, 10)) == keys(search.search(df, q, 10, metric, accept=F.col("vec_id") % 3 == 1))


def test_walks_by_codes_take_lengths_of_codes_once(monkeypatch):
    points = np.random.default_rng(2).normal(size=(200, 8))
    codec = quantize.ProductQuantizer.train(points, 4, 16)
    g = graph.Graph.build(np.arange(200), points, "cosine", OPTIONS)
    g.codes = codec.encode(points).astype(np.int64)
    calls, whole = [], quantize.ProductQuantizer.magnitudes
    monkeypatch.setattr(quantize.ProductQuantizer, "magnitudes", lambda self: calls.append(1) or whole(self))
    for metric in ("cosine", "l2", "dot"):
        g.metric = metric
        for q in points[:5] + 0.1:
            assert (g.provider(q, codec)(list(range(200))) == codec.scores(q[None], g.codes, metric)[0]).all()
    calls.clear()
    g.metric = "cosine"
    found = [g.search(q, 5, 40, codec=codec) for q in points[:5] + 0.1]
    assert not calls and all(len(r.results) == 5 for r in found)


def test_building_and_merging_hold_bounded_products(monkeypatch):
    held, whole = [], search.block_scores
    monkeypatch.setattr(search, "block_scores", lambda metric, q, b: held.append(len(q) * len(b)) or whole(metric, q, b))
    points = np.random.default_rng(4).normal(size=(1200, 6))
    parts = [graph.Graph.build(np.arange(i, 1200, 2), points[i::2], "cosine", OPTIONS) for i in range(2)]
    graph.Graph.merge(parts, OPTIONS)
    assert held and max(held) <= 1 << 18


@pytest.mark.parametrize("metric", ["cosine", "l2", "dot"])
def test_walks_side_by_side_take_the_same_steps_and_keep_less(metric, monkeypatch):
    rng = np.random.default_rng(6)
    points = rng.normal(size=(900, 8))
    points[300:330] = points[7]  # ties
    codec = quantize.ProductQuantizer.train(points, 4, 16)
    g = graph.Graph.build(np.arange(900), points, metric, OPTIONS)
    g.codes = codec.encode(points).astype(np.int64)
    g.delete({11, 12})
    q = np.concatenate([points[:30] + 0.1, points[:3]])
    accept = [None if i % 3 else lambda n: n % 5 > 0 for i in range(len(q))]
    for how in ({}, {"codec": codec}, {"codec": codec, "floor": 0.7}):
        one = [g.search(x, 5, 40, accept=a, **how) for x, a in zip(q, accept)]
        pushed, push = [], heapq.heappush
        monkeypatch.setattr(graph.heapq, "heappush", lambda h, x: pushed.append(x) or push(h, x))
        [g.search(x, 5, 40, accept=a, **how) for x, a in zip(q, accept)]
        before = len(pushed)
        all_ = list(g.search_all(q, 5, 40, accept, **how))
        monkeypatch.undo()
        assert 2 * (len(pushed) - before) < before
        for a, b in zip(one, all_):
            assert [n for _, n in a.results] == [n for _, n in b.results] and np.allclose([s for s, _ in a.results], [s for s, _ in b.results], rtol=1e-15)
            assert (a.visited, a.expanded, a.expanded_base, a.reranked) == (b.visited, b.expanded, b.expanded_base, b.reranked) and b.walk is None


def test_merging_holds_no_sets_of_candidates():
    points = np.random.default_rng(12).normal(size=(2400, 6))
    wide = BuildOptions(degree=12, beam=64)
    parts = [graph.Graph.build(np.arange(i, 2400, 4), points[i::4], "cosine", wide) for i in range(4)]
    graph.Graph.merge(parts, wide)
    tracemalloc.start()
    try:
        graph.Graph.merge(parts, wide).check()
        assert tracemalloc.get_traced_memory()[1] < 40e6
    finally:
        tracemalloc.stop()
