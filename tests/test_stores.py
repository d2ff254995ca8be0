"""Kept datasets and the log of results: what is read after changes, interruptions and clashes."""

import time

import pytest
from pyspark.errors import AnalysisException

from mildtext.sources import cache, files, results


def source(spark, path, values, mode="overwrite"):
    spark.createDataFrame([(v,) for v in values], "x int").write.mode(mode).parquet(path)
    return spark.read.parquet(path)


def test_table_is_built_once_for_one_source(spark, tmp_path):
    calls, path = [], str(tmp_path / "cache")
    df = source(spark, str(tmp_path / "in"), [1, 2, 3])

    def build(df, step=1):
        return lambda: calls.append(step) or df.selectExpr(f"x + {step} as y")

    for _ in range(2):
        got = cache.cached_table(spark, path, build(df), [df], {"step": 1})
        assert sorted(r.y for r in got.collect()) == [2, 3, 4]
    assert calls == [1]
    # other arguments, and the old ones again
    assert sorted(r.y for r in cache.cached_table(spark, path, build(df, 5), [df], {"step": 5}).collect()) == [6, 7, 8]
    cache.cached_table(spark, path, build(df), [df], {"step": 1})
    assert calls == [1, 5]
    # more files, and then files of the same length under the same names
    df = source(spark, str(tmp_path / "in"), [9], "append")
    assert cache.cached_table(spark, path, build(df), [df], {"step": 1}).count() == 4
    assert calls == [1, 5, 1]
    for name in files.names(spark, str(tmp_path / "in")):
        if name.startswith("part"):
            (tmp_path / "in" / name).touch()
    time.sleep(0.01)
    cache.cached_table(spark, path, build(df), [df], {"step": 1})
    assert calls == [1, 5, 1, 1]
    cache.forget(spark, path, [df], {"step": 1})
    assert len(files.names(spark, path)) == 2
    cache.cached_table(spark, path, build(df), [df], {"step": 1})
    assert len(calls) == 4


def test_half_written_table_is_not_read(spark, tmp_path):
    path = str(tmp_path / "cache")
    df = source(spark, str(tmp_path / "in"), [1])

    def breaks():
        spark.range(100).write.parquet(f"{path}/table-half")  # rows, but no manifest
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        cache.cached_table(spark, path, breaks, [df])
    assert cache.cached_table(spark, path, lambda: df, [df]).count() == 1


def test_first_of_two_builders_stays(spark, tmp_path):
    path = str(tmp_path / "cache")

    def slow():
        cache.cached_table(spark, path, lambda: spark.range(3))
        return spark.range(5)

    assert cache.cached_table(spark, path, slow).count() == 3


def rows(spark, *records):
    return spark.createDataFrame(list(records), "experiment string, lang string, sta double")


def read(spark, path):
    return sorted((r["experiment"], r["lang"], r["sta"]) for r in results.load_results(spark, path).collect())


def test_last_save_of_an_experiment_counts(spark, tmp_path):
    path = str(tmp_path / "log")
    results.save_results(rows(spark, ("a", "en", 0.1), ("a", "es", 0.1), ("b", "en", 0.2)), path)
    results.save_results(rows(spark, ("a", "en", 0.3)), path)
    want = [("a", "en", 0.3), ("b", "en", 0.2)]
    assert read(spark, path) == want
    # the same again changes nothing, nor does an interrupted save
    results.save_results(rows(spark, ("a", "en", 0.3)), path)
    half = f"batch-{results._next(spark, path)}"
    rows(spark, ("b", "en", 0.9)).write.json(f"{path}/{half}")
    files.remove(spark, f"{path}/{half}/_SUCCESS")
    assert read(spark, path) == want
    results.compact_results(spark, path)
    assert read(spark, path) == want
    results.save_results(rows(spark, ("c", "en", 0.5)), path)
    results.compact_results(spark, path)
    results.remove_covered(spark, path)
    want.append(("c", "en", 0.5))
    assert read(spark, path) == want
    assert {n.split("-")[0] for n in files.names(spark, path)} == {"batch", "base"}  # what is left of the interrupted save, and one base
    results.save_results(rows(spark, ("b", "de", 0.7)), path)
    assert read(spark, path) == [want[0], ("b", "de", 0.7), want[2]]


def test_batches_of_one_number_and_compaction(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "log")
    for own, name in (("aa", "x"), ("bb", "x"), ("ab", "y")):
        monkeypatch.setattr(results, "_next", lambda *_, own=own: f"000000000007-{own}")
        results.save_results(rows(spark, (name, "en", len(own) + ord(own[0]) / 1000)), path)
    want = [("x", "en", 2.098), ("y", "en", 2.097)]
    assert read(spark, path) == want
    monkeypatch.undo()
    # a base without its last file is not read
    rows(spark, ("z", "en", 1.0)).write.json(f"{path}/base-{results._next(spark, path)}")
    assert read(spark, path) == want
    results.compact_results(spark, path)
    # a save that began before the compaction and ends behind it is no older than it was
    monkeypatch.setattr(results, "_next", lambda *_: "000000000007-ba")
    results.save_results(rows(spark, ("x", "en", 0.0), ("y", "en", 0.0)), path)
    assert read(spark, path) == [("x", "en", 2.098)] + [("y", "en", 0.0)]


def test_no_log(spark, tmp_path):
    with pytest.raises(AnalysisException):
        results.load_results(spark, str(tmp_path / "none"))
