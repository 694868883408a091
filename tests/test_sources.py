import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from spindrift.operators import nvq, quantize
from spindrift.sources import codecs, datasets, index, results, vecs
from spindrift.streaming import ingest


def write(path, rows, kind):
    path.write_bytes(vecs.pack(rows, kind))
    return str(path)


def test_vector_files(spark, tmp_path):
    v = np.random.default_rng(0).normal(size=(9, 5)).astype(np.float32)
    got = vecs.read_fvecs(spark, write(tmp_path / "a.fvecs", v, "<f4")).orderBy("vec_id").collect()
    assert [r.vec_id for r in got] == list(range(9)) and np.array_equal(np.array([r.embedding for r in got], dtype=np.float32), v)
    truth = vecs.ground_truth(vecs.read_ivecs(spark, write(tmp_path / "t.ivecs", [[3, 1], [2, 0]], "<i4")))
    assert sorted(map(tuple, truth.collect())) == [(0, 1, 3), (0, 2, 1), (1, 1, 2), (1, 2, 0)]
    assert vecs.parse(b"", "<f4").shape == (0, 0)
    for bad in (b"\0\0\0\0", b"\xff\xff\xff\xff", vecs.pack([[1, 2]], "<f4")[:-1], vecs.pack([[1.0, 2.0], [1.0]], "<f4") + b"1234", (100_001).to_bytes(4, "little")):
        with pytest.raises(ValueError):
            vecs.parse(bad, "<f4")


def test_catalogue(tmp_path):
    (tmp_path / "more.json").write_text(json.dumps({"b": {"base": "x"}}))
    (tmp_path / "main.json").write_text(json.dumps({"_include": ["${DIR:-more.json}"], "_defaults": {"metric": "dot"}, "a": {"base": "${ROOT}/a.fvecs", "api_key": "123"}}))
    got = datasets.load_catalog(tmp_path / "main.json", {"ROOT": "/data"})
    assert got["a"] == {"metric": "dot", "base": "/data/a.fvecs", "api_key": "123"} and got["b"] == {"base": "x"}
    assert datasets.shown(got["a"])["api_key"] == "***"
    with pytest.raises(KeyError):
        datasets.load_catalog(tmp_path / "main.json", {})


def test_load_and_scrub(spark, tmp_path):
    base = [[3.0, 0.0], [0.0, 0.0], [3.0, 0.0], [0.0, 2.0], [1.0, 1.0]]
    queries = [[2.0, 1.0], [0.0, 2.0], [1.0, 5.0]]
    entry = {"base": write(tmp_path / "b.fvecs", base, "<f4"), "queries": write(tmp_path / "q.fvecs", queries, "<f4"), "truth": write(tmp_path / "t.ivecs", [[2, 0, 4], [3, 4, 0], [3, 4, 2]], "<i4"), "metric": "dot"}
    plain = datasets.load(spark, "d", {}, {"d": entry})
    assert plain.base.count() == 5 and plain.queries.count() == 3
    clean = datasets.load(spark, "d", {"d": entry | {"load": "scrub"}})
    rows = clean.base.orderBy("vec_id").collect()
    assert [r.vec_id for r in rows] == [0, 1, 2] and np.allclose([np.linalg.norm(r.embedding) for r in rows], 1)
    assert clean.queries.count() == 2  # one query was a base vector
    assert sorted(map(tuple, clean.truth.collect())) == [(0, 1, 0), (0, 2, 2), (1, 1, 1), (1, 2, 2), (1, 3, 0)]
    with pytest.raises(KeyError):
        datasets.load(spark, "other", {"d": entry})


def test_index_directory(spark, tmp_path):
    v = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(6)], "vec_id long, embedding array<float>")
    path = str(tmp_path / "index")
    made = index.Writer(path, "l2").add("vectors", v).note(degree=4).write()
    assert made.meta["rows"] == 6 and made.meta["dim"] == 2 and made.meta["degree"] == 4
    assert index.read(spark, path, verify=True).vectors.count() == 6
    with pytest.raises(ValueError, match="no graph"):
        made.feature("graph")
    more = index.append(path, v.withColumn("vec_id", F.col("vec_id") + 10))
    assert more.meta["rows"] == 12 and more.meta["degree"] == 4 and index.read(spark, path, verify=True).vectors.count() == 12
    with pytest.raises(ValueError, match="dimensions"):
        index.append(path, spark.createDataFrame([(99, [1.0])], "vec_id long, embedding array<float>"))
    v.write.mode("append").parquet(f"{path}/vectors")
    with pytest.raises(ValueError):
        index.read(spark, path, verify=True)
    with pytest.raises(ValueError):
        index.Writer(path).write()
    with pytest.raises(ValueError):
        index.Writer(path).add("other", v)
    assert index.cached_path("/r", a=1, b=2) == index.cached_path("/r", b=2, a=1) != index.cached_path("/r", a=1, b=3)


def test_codecs_are_read_again(spark, tmp_path):
    points = np.random.default_rng(1).normal(size=(80, 6))
    v = spark.createDataFrame([(i, [float(x) for x in p]) for i, p in enumerate(points)], "vec_id long, embedding array<float>")
    for codec in (quantize.ProductQuantizer.train(points, 2, 8, center=True), quantize.ProductQuantizer.train(points, 3, 8, threshold=0.5)):
        made = index.Writer(str(tmp_path / f"i{codec.m}")).add("vectors", v).add("codes", quantize.pq_encode(v, codec)).add("codec", codecs.save(spark, codec)).write()
        again = made.quantizer()
        assert (again.encode(points) == codec.encode(points)).all() and np.allclose(again.decode(codec.encode(points)), codec.decode(codec.encode(points))) and again.weight == codec.weight
        assert made.feature("codes").count() == 80
    flat = nvq.NonUniformQuantizer.train(points, 2)
    made = index.Writer(str(tmp_path / "n")).add("vectors", v).add("nvq", nvq.nvq_encode(v, flat)).add("codec", codecs.save(spark, flat)).write()
    assert np.allclose(made.quantizer().decode(nvq.unpack([[p.asDict() for p in r.parts] for r in made.nvq.orderBy("vec_id").collect()])), flat.decode(flat.encode(points.astype(np.float32).astype(float))))
    assert codecs.load(codecs.save(spark, codecs.BinaryCodec(64))) == codecs.BinaryCodec(64)
    for bad in (lambda: codecs.save(spark, object()), lambda: codecs.load(spark.createDataFrame([], codecs.SCHEMA))):
        with pytest.raises((TypeError, ValueError)):
            bad()


def test_results_are_gone_on_from(spark, tmp_path):
    schema = "degree int, beam int, recall double"
    for format in results.FORMATS:
        path = str(tmp_path / format)
        runs = [{"degree": d, "beam": b} for d in (8, 16) for b in (50, 100)]
        assert results.missing(results.read(spark, path, schema, format), runs) == runs
        results.append(spark.createDataFrame([(8, 50, 0.9), (16, 100, 0.95)], schema), path, format)
        results.append(spark.createDataFrame([(8, 100, None)], schema), path, format)
        done = results.read(spark, path, schema, format)
        assert done.count() == 3 and results.missing(done, runs) == [{"degree": 16, "beam": 50}]
    with pytest.raises(ValueError):
        results.append(done, str(tmp_path / "x"), "xml")
    with pytest.raises(ValueError, match="depth"):
        results.missing(done, [{"depth": 1}])


def test_streams(spark, tmp_path):
    source, path = str(tmp_path / "in"), str(tmp_path / "out")
    rows = lambda ids: spark.createDataFrame([(i, [float(i), 0.0]) for i in ids], "vec_id long, embedding array<float>")
    rows(range(4)).write.parquet(source)
    stream = lambda: spark.readStream.schema("vec_id long, embedding array<float>").parquet(source)
    ingest.ingest(stream(), path, str(tmp_path / "c1")).awaitTermination()
    rows(range(3, 7)).write.mode("append").parquet(source)
    ingest.ingest(stream(), path, str(tmp_path / "c1")).awaitTermination()
    assert sorted((r.vec_id, r.version) for r in ingest.snapshot(spark, path).collect()) == [(0, 1), (1, 1), (2, 1), (3, 2), (4, 2), (5, 2), (6, 2)]
    assert ingest.snapshot(spark, path, up_to=1).count() == 4
    spark.createDataFrame([(1,), (5,), (None,)], "vec_id long").write.parquet(str(tmp_path / "gone"))
    ingest.delete(spark.readStream.schema("vec_id long").parquet(str(tmp_path / "gone")), path, str(tmp_path / "c2")).awaitTermination()
    got = ingest.compact(spark, path, str(tmp_path / "compact")).orderBy("vec_id").collect()
    assert [(r.vec_id, r.old_id) for r in got] == [(0, 0), (1, 2), (2, 3), (3, 4), (4, 6)]
    # a pinned version does not see later deletions, and an id can come back
    assert ingest.snapshot(spark, path, up_to=2).count() == 7 and ingest.snapshot(spark, path, up_to=3).count() == 5
    rows([5]).write.mode("append").parquet(source)
    ingest.ingest(stream(), path, str(tmp_path / "c1")).awaitTermination()
    assert sorted((r.vec_id, r.version) for r in ingest.snapshot(spark, path).collect()) == [(0, 1), (2, 1), (3, 2), (4, 2), (5, 4), (6, 2)]
    assert ingest.snapshot(spark, path, up_to=3).count() == 5
    # a batch that is tried again keeps its version
    assert ingest.claimed(spark, path, ingest.VECTORS, 1) == 2 and ingest.claimed(spark, path, ingest.TOMBSTONES, 0) == 3 and ingest.claimed(spark, path, ingest.VECTORS, 9) == 5
