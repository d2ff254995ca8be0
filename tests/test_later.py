"""Copies out of one sorted stream, next to plain Python."""

import random

import pytest

from mildtext.operators import prepare
from mildtext.operators.later import later_rows


def plain(rows):
    seen, out = set(), []
    for lang, pair, rank, i in sorted(rows, key=lambda r: (r[2], r[3])):
        if (lang, pair) in seen:
            out.append((rank, i))
        seen.add((lang, pair))
    return sorted(out)


@pytest.mark.parametrize("partitions", ["1", "4", "31"])
def test_same_as_plain_python(spark, partitions):
    pick = random.Random(int(partitions))
    rows = [(pick.choice(["en", "es", None]), pick.choice(["a", "b", "1:a", "-", "", None, f"own {i}"]), pick.randint(0, 2), i) for i in range(800)]
    # one pair is nine rows in ten
    rows += [("en", "hot", i % 3, 1000 + i) for i in range(7200)]
    pick.shuffle(rows)
    df = spark.createDataFrame(rows, "lang string, pair string, rank int, id long").repartition(7)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = later_rows(df, ["lang", "pair"], ["rank", "id"])
        assert sorted(map(tuple, got.collect())) == plain(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_few_rows(spark):
    ddl = "lang string, pair string, rank int, id long"
    assert later_rows(spark.createDataFrame([], ddl), ["lang", "pair"], ["rank", "id"]).collect() == []
    one = spark.createDataFrame([("en", "a", 0, 1)], ddl)
    assert later_rows(one, ["lang", "pair"], ["rank", "id"]).collect() == []


def test_hot_pair_is_spread_over_tasks(spark, monkeypatch):
    from mildtext import session
    from mildtext.operators import later

    seen = []
    monkeypatch.setattr(later, "materialize", lambda df: seen.append(session.materialize(df)) or seen[-1])
    df = spark.range(40_000).selectExpr("'en' lang", "'hot' pair", "0 rank", "id")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert later_rows(df, ["lang", "pair"], ["rank", "id"]).count() == 39_999
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    per_task = [r["count"] for r in seen[0].filter("kind <= 1").groupBy("part").count().collect()]
    assert len(per_task) > 1 and max(per_task) < 30_000


def test_dedup_gives_what_it_keeps(spark):
    rows = [(i, "en" if i % 2 else None, "s", i % 3, f"t{i % 5}", "n") for i in range(200)]
    df = spark.createDataFrame(rows, "pair_id long, lang string, source string, source_rank int, toxic string, neutral string")
    kept, keys = prepare.dedup_with_keys(df)
    first = {}
    for r in sorted(rows, key=lambda r: (r[3], r[0])):
        first.setdefault((r[1], r[4]), (r[1], r[3], r[0]))
    want = sorted(first.values(), key=repr)
    assert sorted(((r.lang, r.source_rank, r.pair_id) for r in kept.collect()), key=repr) == want
    assert sorted(((r.lang, r.source_rank, r.pair_id) for r in keys.collect()), key=repr) == want
