import zipfile
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from mildtext import session
from mildtext.config import PrepConfig
from mildtext.operators import diversity, prepare, quota
from mildtext.operators import tokenize as tk
from mildtext.plans import prepare_all as pa
from mildtext.sources import pairs as ps

SCHEMA = "pair_id bigint, lang string, source string, source_rank int, toxic string, neutral string"


def pairs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_ratio_limit_is_inclusive(spark):
    df = pairs(spark, [
        (1, "en", "a", 0, "one two three", "x"), (2, "en", "a", 0, "one two three four", "x"),
        (3, "en", "a", 0, "x", "  "), (4, "en", "a", 0, "x", "1 2 3"),
    ])
    assert sorted(r["pair_id"] for r in prepare.length_ratio_filter(df).collect()) == [1, 4]


def test_dedup_keeps_first_source_and_case(spark):
    df = pairs(spark, [
        (9, "en", "b", 1, "same", "pair"), (7, "en", "a", 0, "same", "pair"), (8, "en", "a", 0, "same", "pair"),
        (1, "en", "a", 0, "A", "b"), (2, "en", "a", 0, "a", "b"), (3, "es", "a", 0, "a", "b"),
    ])
    once = prepare.dedup_pairs(df)
    assert sorted(r["pair_id"] for r in once.collect()) == [1, 2, 3, 7]
    again = prepare.dedup_pairs(once.drop("pair_hash"))
    assert sorted(r["pair_id"] for r in again.collect()) == [1, 2, 3, 7]


def test_dedup_cuts_copies_before_the_shuffle(spark):
    plan = prepare.dedup_pairs(pairs(spark, [(1, "en", "a", 0, "a", "b")]))._jdf.queryExecution().executedPlan().toString()
    # the texts stay where they are: only the ids of the copies move
    assert "Exchange hashpartitioning" not in plan and "BroadcastHashJoin" in plan and "LeftAnti" in plan


def test_funnel_adds_up(spark):
    df = pairs(spark, [
        (1, "en", "a", 0, "a", "b"), (2, "en", "a", 0, "a", "b"), (3, "en", "a", 0, " ", "b"),
        (4, "en", "a", 0, "a b c d", "b"), (5, "en", "a", 0, "c", "b"),
    ])
    row = prepare.preprocess_funnel(df).collect()[0].asDict()
    assert row == {"lang": "en", "n_orig": 5, "n_empty": 1, "n_length": 1, "n_dup": 1, "n_final": 2}
    assert prepare.preprocess_pairs(df).count() == 2


def test_split_counts(spark):
    sizes = {"a": 1, "b": 9, "c": 1000, "d": 0}
    rows = [(i, lang, "s", 0, "t", "n") for lang, n in sizes.items() for i in range(n)]
    got = quota.split_pairs(pairs(spark, rows), {"b": (0.12, 0.08), "c": (0.12, 0.08)})
    counts = {(r["lang"], r["split"]): r["count"] for r in got.groupBy("lang", "split").count().collect()}
    assert counts == {("a", "val"): 1, ("b", "val"): 1, ("b", "train"): 8, ("c", "val"): 120, ("c", "test"): 80, ("c", "train"): 800}


def test_split_does_not_depend_on_partitions(spark):
    rows = pairs(spark, [(i, "en", "s", 0, "t", "n") for i in range(500)])
    a = quota.split_pairs(rows.repartition(7), {}).select("pair_id", "split").collect()
    b = quota.split_pairs(rows.coalesce(1), {}).select("pair_id", "split").collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))
    c = quota.split_pairs(rows, {}, seed=7).select("pair_id", "split").collect()
    assert sorted(map(tuple, a)) != sorted(map(tuple, c))


def test_thresholds_equal_a_plain_window(spark, monkeypatch):
    """With one digit the buckets hold many rows, so the ranking inside a bucket is used."""
    monkeypatch.setattr(quota, "BUCKET_DIGITS", 1)
    rows = pairs(spark, [(i, "en" if i % 3 else "es", "s", 0, "t", "n") for i in range(400)])
    picked = quota.random_sample(rows, 37)
    assert picked.groupBy("lang").count().where("count <> 37").count() == 0
    rows.createOrReplaceTempView("sample_rows")
    expected = spark.sql(
        "select pair_id from (select *, row_number() over (partition by lang order by md5(concat('42|', pair_id)), pair_id) r "
        "from sample_rows) where r <= 37"
    )
    assert {r[0] for r in picked.select("pair_id").collect()} == {r[0] for r in expected.collect()}


def test_rows_without_language_are_a_group(spark):
    rows = pairs(spark, [(i, "en" if i % 2 else None, "s", 0, "t", "n") for i in range(40)])
    split = quota.split_pairs(rows, {}).groupBy("lang", "split").count().collect()
    assert {(r["lang"], r["split"]): r["count"] for r in split} == {
        ("en", "train"): 15, ("en", "val"): 5, (None, "train"): 15, (None, "val"): 5}
    assert quota.random_sample(rows, 3).count() == 6


def test_sample_larger_than_group(spark):
    rows = pairs(spark, [(i, "en", "s", 0, "t", "n") for i in range(5)])
    assert quota.random_sample(rows, 50).count() == 5


def test_text_is_not_shuffled_by_split(spark):
    rows = pairs(spark, [(i, "en", "s", 0, "t", "n") for i in range(5)])
    plan = quota.split_pairs(rows, {})._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "BroadcastHashJoin" in plan


def test_normalise_alternate_names(spark):
    df = spark.createDataFrame(
        [(1, "es", None, " a ", "x"), (2, "es", "", "b", "y"), (3, "es", "  ", "c", "z")],
        "pair_id long, lang string, toxic_sentence string, toxic string, neutral string",
    )
    got = {r["pair_id"]: (r["toxic"], r["neutral"]) for r in ps.normalize_pairs(df, "extra").collect()}
    # a blank first column is chosen, then stripped, then dropped
    assert got == {1: ("a", "x"), 2: ("b", "y")}


def test_missing_source_and_missing_language(spark, tmp_path):
    empty = ps.normalize_pairs(ps.read_or_empty(spark, str(tmp_path / "none")), "extra")
    assert empty.count() == 0 and empty.columns == ["pair_id", "lang", "source", "source_rank", "toxic", "neutral"]
    df = spark.createDataFrame([(1, "en", "t", "n"), (2, "de", "t", "n")], "pair_id long, lang string, toxic_sentence string, neutral_sentence string")
    ps.write_pairs(df, str(tmp_path / "pairs"))
    back = ps.load_pairs(ps.read_files(spark, str(tmp_path / "pairs")), ["en", "xx"])
    assert [r["pair_id"] for r in back.collect()] == [1]
    assert "PartitionFilters: [" in back._jdf.queryExecution().toString()


def test_formats(spark, tmp_path):
    df = spark.createDataFrame([(1, "en", 'a "q", b\nc', "n")], "pair_id long, lang string, toxic_sentence string, neutral_sentence string")
    df.write.json(str(tmp_path / "j"))
    df.write.option("header", True).option("escape", '"').csv(str(tmp_path / "c"))
    for fmt, path in (("json", "j"), ("csv", "c")):
        got = ps.load_pairs(ps.read_files(spark, str(tmp_path / path), fmt), ["en"]).collect()
        assert got[0]["toxic"] == 'a "q", b\nc'


def test_tokenised_shape(spark):
    df = spark.createDataFrame([(1, "a b", "c"), (2, "w " * 300, "")], "pair_id long, toxic string, neutral string")
    rows = {r["pair_id"]: r for r in tk.tokenize_pairs(df, max_length=16).collect()}
    for row in rows.values():
        assert len(row["input_ids"]) == len(row["attention_mask"]) == len(row["labels"]) == 16
    assert rows[1]["input_ids"][3] == tk.END and rows[1]["attention_mask"] == [1] * 4 + [0] * 12
    assert rows[1]["labels"][1] == tk.END and rows[1]["labels"][2:] == [tk.IGNORE] * 14
    assert rows[2]["input_ids"][-1] == tk.END and tk.PAD not in rows[2]["input_ids"]


def test_whole_preparation(spark):
    cfg = PrepConfig(target_langs=("es",), few_shot_sizes=(2, 5))
    rows = [(i, "en" if i % 2 else "es", "s", 0, f"toxic {i // 4}", "neutral text") for i in range(80)]
    rows += [(100, "xx", "s", 0, "a", "b")]
    ready = pa.prepare_pairs([pairs(spark, rows)], cfg)
    counts = {(r["lang"], r["split"]): r["count"] for r in ready.groupBy("lang", "split").count().collect()}
    assert counts == {("en", "train"): 17, ("en", "val"): 2, ("en", "test"): 1, ("es", "train"): 15, ("es", "val"): 5}
    train = pa.clean_and_split([pairs(spark, rows)], cfg).filter("split = 'train'")
    few = pa.few_shot_subsets(train, cfg, vector=None)
    assert {r["n_shots"]: r["count"] for r in few.groupBy("n_shots").count().collect()} == {2: 2, 5: 5}


def test_preview_and_summary(spark):
    rows = pairs(spark, [(i, "en", "s", 0, "t" * 150, "n") for i in range(3)]).withColumn("split", F.lit("train"))
    first = prepare.split_preview(rows).collect()[0]
    assert first["pair_id"] == 0 and len(first["toxic_start"]) == 100
    assert prepare.data_summary(rows).collect()[0]["n"] == 3


def test_few_shot_subsets_are_exact_over_sources_with_equal_ids(spark):
    from mildtext.config import PrepConfig
    from mildtext.plans.prepare_all import few_shot_subsets

    rows = [(i, "es", "s", rank, f"t{rank}{i}", "n", [float(i), float(rank)]) for rank in (0, 1) for i in range(12)]
    train = spark.createDataFrame(rows, "pair_id long, lang string, source string, source_rank int, toxic string, neutral string, embedding array<double>")
    cfg = PrepConfig(target_langs=("es",), few_shot_sizes=(5, 100))
    for vector in (None, "embedding"):
        got = few_shot_subsets(train, cfg, vector, n_init=1).collect()
        counts = Counter(r["n_shots"] for r in got)
        assert counts == {5: 5, 100: 24}
        assert len({(r["n_shots"], r["source_rank"], r["pair_id"]) for r in got}) == 29
    with pytest.raises(ValueError, match="name them by more columns"):
        diversity.diversity_sample(train, 5, "pair_id", None)


def test_dedup_and_split_write_ids_only(spark, monkeypatch):
    from mildtext.operators import quota as q

    seen = []
    original = session.materialize
    monkeypatch.setattr(session, "materialize", lambda df: seen.append(df.columns) or original(df))
    monkeypatch.setattr(q, "materialize", lambda df: seen.append(df.columns) or original(df))
    df = pairs(spark, [(i, "en", "a", 0, f"a{i % 3}", "b") for i in range(9)])
    assert q.split_pairs(prepare.dedup_pairs(df), {}).count() == 3
    assert seen and not any({"toxic", "neutral"} & set(columns) for columns in seen)


def test_nothing_is_left_after_release(spark):
    df = pairs(spark, [(i, "en", "a", 0, f"a{i % 3}", "b") for i in range(9)])
    assert prepare.dedup_pairs(df).count() == 3
    folder = Path(session.scratch(spark).removeprefix("file:"))
    assert any(folder.iterdir())
    session.release(spark)
    assert not folder.exists()


def test_package_for_the_executors_holds_the_functions(spark):
    with zipfile.ZipFile(session.ship(spark)) as archive:
        assert "mildtext/operators/grams.py" in archive.namelist()


def test_tokenised_dataset_by_language_and_split(spark, tmp_path):
    rows = spark.createDataFrame([(1, "en", "train"), (2, "es", "val")], "pair_id int, lang string, split string")
    tk.save_tokenized(rows, str(tmp_path / "set"))
    tk.save_tokenized(rows.filter("lang = 'es'").withColumn("pair_id", F.lit(3)), str(tmp_path / "set"))
    got = tk.load_tokenized(spark, str(tmp_path / "set"))
    assert sorted(r["pair_id"] for r in got.collect()) == [1, 3]
    assert tk.load_tokenized(spark, str(tmp_path / "set"), lang="es").count() == 1


def test_plans_of_plain_sources_have_no_exchange(spark):
    from mildtext.plans.queries import QUERIES

    for name in ("load_inputs", "delete_exact", "toxicity_lexicon"):
        plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan, name
