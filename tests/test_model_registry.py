"""Versions, aliases and racing writers of the model registry."""

import threading

import pytest
from pyspark.sql import functions as F

from kestrel.operators import boosting as bo
from kestrel.operators import ml
from kestrel.operators.model_registry import ModelRegistry
from kestrel.sources.sinks import append_partition


def text_model(spark, text):
    return lambda folder: spark.createDataFrame([(text,)], "value string").write.text(folder)


def test_versions_aliases_and_metrics(spark, tmp_path):
    r = ModelRegistry(spark, str(tmp_path))
    with pytest.raises(LookupError):
        r.resolve("m")
    assert r.log("m").collect() == []
    assert [r.register("m", text_model(spark, f"v{k}"), {"auc": k / 10}) for k in (1, 2, 3)] == [1, 2, 3]
    with pytest.raises(LookupError):
        r.resolve("m", "Champion")  # a version is not an alias
    r.promote("m", 2)
    r.promote("m", 3, "Challenger")
    assert r.resolve("m")[0] == 2 and r.resolve("m", "Challenger")[0] == 3
    r.promote("m", 1)
    version, folder = r.resolve("m")
    assert version == 1 and spark.read.text(folder).first()[0] == "v1"
    with pytest.raises(LookupError):
        r.promote("m", 9)
    assert r.register("other", text_model(spark, "x")) == 1  # names are apart
    assert [x.action for x in r.log("m").orderBy("commit").collect()] == ["register"] * 3 + ["promote"] * 3
    assert {(x.version, x.key): x.value for x in r.metrics("m").collect()} == {(1, "auc"): 0.1, (2, "auc"): 0.2, (3, "auc"): 0.3}


def test_a_failed_save_makes_no_version(spark, tmp_path):
    r = ModelRegistry(spark, str(tmp_path))

    def fail(folder):
        raise OSError("disk")

    with pytest.raises(OSError):
        r.register("m", fail)
    assert r.register("m", text_model(spark, "a")) == 1


def test_racing_writers_lose_no_commit(spark, tmp_path):
    versions, each = [], 6

    def write(who):
        r = ModelRegistry(spark, str(tmp_path))
        for k in range(each):
            v = r.register("m", text_model(spark, f"{who}.{k}"))
            versions.append((v, f"{who}.{k}"))
            r.promote("m", v)
            seen, folder = r.resolve("m")  # always a whole model, of that version or a later move
            assert spark.read.text(folder).count() == 1 and seen >= 1

    threads = [threading.Thread(target=write, args=(w,)) for w in "abc"]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    r = ModelRegistry(spark, str(tmp_path))
    log = r.log("m").orderBy("commit").collect()
    assert [x.commit for x in log] == list(range(1, 6 * each + 1))
    assert sorted(v for v, _ in versions) == list(range(1, 3 * each + 1))
    folders = {x.version: x.folder for x in log if x.action == "register"}
    assert all(spark.read.text(folders[v]).first()[0] == text for v, text in versions)
    moves = [x for x in log if x.action == "promote"]
    assert len(moves) == 3 * each and r.resolve("m") == (moves[-1].version, moves[-1].folder)


def test_create_if_absent_on_a_hadoop_file_system(spark, tmp_path, monkeypatch):
    """The way of other file systems (no hard links), on the local one."""
    r = ModelRegistry(spark, str(tmp_path))
    fs_of = r._fs

    class Remote:
        def __init__(self, fs):
            self.fs = fs

        def getScheme(self):
            return "hdfs"

        def __getattr__(self, name):
            return getattr(self.fs, name)

    monkeypatch.setattr(r, "_fs", lambda path: (fs_of(path)[0], Remote(fs_of(path)[1])))
    assert r._create(f"{tmp_path}/m/log/000000000001.json", "{}")
    assert not r._create(f"{tmp_path}/m/log/000000000001.json", "{}")
    assert r.register("n", text_model(spark, "a")) == 1
    r.promote("n", 1)
    assert r.resolve("n")[0] == 1


def test_spark_ml_models_by_alias(spark, tmp_path):
    """M2: a regression pipeline, saved and loaded by alias, predicts the same."""
    from pyspark.ml import PipelineModel

    df = spark.createDataFrame([(float(i), None if i % 9 == 0 else float(i % 4), 2.0 * i + (i % 4)) for i in range(60)], "a double, b double, label double")
    model = ml.fit(df, ["a", "b"], "label", "regression", trees=5, depth=3)
    r = ModelRegistry(spark, str(tmp_path))
    r.promote("reg", r.register("reg", lambda folder: model.write().save(folder)))
    back = PipelineModel.load(r.resolve("reg")[1])
    want, got = (ml.score(m, df, ["a"], "reg", "2002-01-01").select("a", "prediction") for m in (model, back))
    assert want.exceptAll(got).isEmpty()
    error = got.join(df, "a").agg(F.avg(F.abs(F.col("prediction") - F.col("label")))).first()[0]
    assert error < 10


def test_append_keeps_other_dates_and_replaces_its_own(spark, tmp_path):
    path = str(tmp_path / "scores")
    day = lambda d, n: spark.range(n).withColumn("score_date", F.lit(d).cast("date"))
    assert append_partition(day("2002-01-01", 5), path, "score_date") == 5
    assert append_partition(day("2002-01-02", 7), path, "score_date") == 7
    assert append_partition(day("2002-01-02", 6), path, "score_date") == 6
    assert {str(r.score_date): r["count"] for r in spark.read.parquet(path).groupBy("score_date").count().collect()} == {"2002-01-01": 5, "2002-01-02": 6}


def test_boosted_model_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(i, float(i % 3), i % 3) for i in range(60)], "id long, x double, y long")
    model = bo.fit(df, ["x"], "y", 3, options=bo.Options(rounds=1, depth=2, bins=4, min_hessian=0.1))
    r = ModelRegistry(spark, str(tmp_path))
    r.promote("b", r.register("b", lambda folder: bo.save(model, spark, folder), {"classes": 3}))
    back = bo.load(spark, r.resolve("b")[1])
    assert back.trees.startswith(r.resolve("b")[1])
    assert all(x.prediction == x.y for x in bo.score(back, df, ["id", "y"], 1).collect())
