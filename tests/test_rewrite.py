import re

import pytest
from pyspark.sql import functions as F

from mildtext.functions.terms import BUILTIN_TERMS
from mildtext.operators import rewrite as rw
from mildtext.operators import score, skew
from mildtext.sources import lexicon as lx


def brute_delete(text, terms, match):
    kept = []
    for token in text.split():
        word = re.sub(r"[^\w]", "", token.lower())
        hit = word in terms
        if match == "prefix":
            hit = hit or any(
                word.startswith(t) or t.startswith(word) for t in terms if len(t) >= 4 and len(word) >= 4
            )
        if not hit:
            kept.append(token)
    return " ".join(kept) or text


TERMS = {"en": ["idiot", "moron", "hell", "motherland", "ass", "two words", "co-op"], "es": ["tonto", "mierda"]}
TEXTS = [
    ("en", "You are an IDIOT, really"), ("en", "Idiot! moron"), ("en", "hey ... idiot"),
    ("en", "hello mother assassin ass"), ("en", "  spaced\tout\n idiot  "), ("en", ""), ("en", " "),
    ("es", "un tonto idiot mierdas"), ("xx", "tonto idiot fine"), ("en", "coop two words moth"),
    ("en", "hel moro moron-ic idiots"), ("en", "... !!!"), (None, "tonto idiot fine"),
]


def expected(lang, text, match):
    terms = set(TERMS.get(lang) or sum(TERMS.values(), []))
    return brute_delete(text, terms, match)


@pytest.mark.parametrize("match", ["exact", "prefix"])
@pytest.mark.parametrize("form", ["inline", "shared", "joined"])
def test_delete_against_brute_force(spark, monkeypatch, match, form):
    df = spark.createDataFrame([(i, lang, t, 1) for i, (lang, t) in enumerate(TEXTS)], "id int, lang string, text string, flat int")
    if form == "inline":
        got = rw.delete_inline(df.drop("flat"), TERMS, match)
    else:
        monkeypatch.setattr(rw, "LEXICON_BYTES", 1 << 30 if form == "shared" else 0)
        got = rw.delete_terms(df, lx.lexicon_from_terms(spark, TERMS), "id", match)
        assert got.columns == [*df.columns, "prediction"]
    rows = got.collect()
    assert len(rows) == len(TEXTS)
    for row in rows:
        assert row["prediction"] == expected(row["lang"], row["text"], match), row


@pytest.mark.parametrize("limit", [0, 1 << 30])
@pytest.mark.parametrize("match", ["exact", "prefix"])
def test_flag_counts_agree(spark, monkeypatch, match, limit):
    monkeypatch.setattr(rw, "LEXICON_BYTES", limit)
    df = spark.createDataFrame([(i, lang, t) for i, (lang, t) in enumerate(TEXTS)], "id int, lang string, text string")
    inline = score.lexicon_toxicity(df, TERMS, match).orderBy("id").collect()
    joined = score.lexicon_toxicity_joined(df, lx.lexicon_from_terms(spark, TERMS), "id", match).orderBy("id").collect()
    assert inline == joined
    assert [r["n_tokens"] for r in inline] == [len(t.split()) for _, t in TEXTS]
    assert inline[1]["n_flagged"] == 2 and inline[1]["tox"] == pytest.approx(2 / 3) and inline[5]["tox_ratio"] == 0.0


@pytest.mark.parametrize("limit", [0, 1 << 30])
def test_extra_terms_add_to_the_base_of_their_language(spark, monkeypatch, limit):
    monkeypatch.setattr(rw, "LEXICON_BYTES", limit)
    extra = {"de": ["trottel"], "en": ["clown"]}
    texts = [("de", "du idiot und trottel", "du und"), ("en", "a clown idiot tonto trottel here", "a tonto trottel here"),
             ("fr", "un idiot trottel clown tonto", "un trottel clown"), (None, "idiot clown", "clown")]
    df = spark.createDataFrame([(i, lang, t) for i, (lang, t, _) in enumerate(texts)], "id int, lang string, text string")
    got = rw.delete_terms(df, lx.lexicon_from_terms(spark, TERMS), "id", "exact", extra=lx.lexicon_from_terms(spark, extra))
    assert [r["prediction"] for r in got.orderBy("id").collect()] == [want for _, _, want in texts]


def test_unknown_labels_share_one_scope(spark, monkeypatch):
    monkeypatch.setattr(rw, "LEXICON_BYTES", 0)
    lexicon = lx.lexicon_from_terms(spark, TERMS)
    rows = sum(map(len, TERMS.values()))
    assert rw.scope_lexicon(lexicon).count() <= 2 * rows
    df = spark.createDataFrame([(i, f"junk {i}", "a tonto idiot here") for i in range(1000)], "id int, lang string, text string")
    assert {r["prediction"] for r in rw.delete_terms(df, lexicon, "id").collect()} == {"a here"}


@pytest.mark.parametrize("limit", [0, 1 << 30])
def test_long_text_of_matching_words(spark, monkeypatch, limit):
    monkeypatch.setattr(rw, "LEXICON_BYTES", limit)
    words = [f"idiot{i}" for i in range(40_000)]
    df = spark.createDataFrame([(1, "en", " ".join([*words, "end"]))], "id int, lang string, text string")
    assert rw.delete_terms(df, lx.lexicon_from_terms(spark, TERMS), "id").collect()[0]["prediction"] == "end"


def test_shared_lexicon_moves_no_text(spark):
    df = spark.createDataFrame([(1, "en", "a")], "id int, lang string, text string")
    plan = rw.delete_terms(df, lx.lexicon_from_terms(spark, TERMS), "id")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_hello_only_goes_in_prefix_mode(spark):
    df = spark.createDataFrame([("en", "hello mother")], "lang string, text string")
    terms = {"en": ["hell", "motherland"]}
    assert rw.delete_inline(df, terms, "exact").collect()[0]["prediction"] == "hello mother"
    # both tokens match, so the text would be empty and is kept
    assert rw.delete_inline(df, terms, "prefix").collect()[0]["prediction"] == "hello mother"
    longer = df.withColumn("text", F.lit("hello mother nature"))
    assert rw.delete_inline(longer, terms, "prefix").collect()[0]["prediction"] == "nature"


def test_devanagari_marks(spark):
    df = spark.createDataFrame([("hi", "तुम पागल हो")], "lang string, text string")
    default = rw.delete_inline(df, BUILTIN_TERMS, "exact").collect()[0]["prediction"]
    kept = rw.delete_inline(df, BUILTIN_TERMS, "exact", keep_marks=True).collect()[0]["prediction"]
    assert default == "तुम पागल हो"
    assert kept == "तुम हो"


def test_prefix_plan_has_no_nested_loop(spark):
    lexicon = lx.lexicon_from_terms(spark, TERMS)
    vocab = spark.createDataFrame([("en", "hello"), ("en", "fine")], "lang string, token string")
    plan = rw.flag_vocabulary(vocab, lexicon)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_inline_plan_has_no_shuffle(spark):
    df = spark.createDataFrame([("en", "a")], "lang string, text string")
    plan = rw.delete_inline(df, TERMS)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_baselines(spark):
    df = spark.createDataFrame([(1, "en", "an idiot here", "x")], "pair_id int, lang string, toxic string, neutral string")
    lexicon = lx.lexicon_from_terms(spark, TERMS)
    assert rw.run_baseline("delete", df, lexicon).collect()[0]["prediction"] == "an here"
    assert rw.run_baseline("identity", df, lexicon).collect()[0]["prediction"] == "an idiot here"
    with pytest.raises(ValueError, match="Unknown baseline"):
        rw.run_baseline("other", df, lexicon)


@pytest.mark.parametrize("limit", [0, 1 << 20])
def test_lookup_with_hot_keys(spark, monkeypatch, limit):
    monkeypatch.setattr(skew, "HOT_SHARE", 4)
    monkeypatch.setattr(skew, "SHARED_BYTES", limit)
    rows = spark.createDataFrame([(i, "hot" if i % 2 else f"k{i % 30}") for i in range(300)], "id int, k string")
    table = spark.createDataFrame([("hot", 1), ("k2", 2), ("k4", 4)], "k string, v int")
    counts = skew.key_counts(rows, ["k"])
    got = {r["id"]: (r["k"], r["v"]) for r in skew.lookup(rows, table, ["k"], ["v"], counts, ["id"]).collect()}
    assert len(got) == 300
    assert all(v == {"hot": 1, "k2": 2, "k4": 4}.get(k) for k, v in got.values())


def test_lexicon_source(spark):
    raw = spark.createDataFrame(
        [("en", None, " Bad "), ("en", "", "bad"), ("es", "MAL", "x"), ("xx", "y", "y"), ("en", " ", "z")],
        "lang string, word string, term string",
    )
    loaded = lx.load_lexicon(raw, ["en", "es", "hi"])
    assert sorted(map(tuple, loaded.collect())) == [("en", "bad"), ("es", "mal")]
    base = lx.lexicon_from_terms(spark, {"en": ["bad", "worse"]})
    growth = {r["lang"]: r.asDict() for r in lx.lexicon_growth(base, loaded).collect()}
    assert growth["en"] == {"lang": "en", "n_before": 2, "n_after": 2, "n_added": 0}
    assert growth["es"] == {"lang": "es", "n_before": 0, "n_after": 1, "n_added": 1}
    assert lx.all_language_terms(lx.union_lexicons(base, loaded)).count() == 3


def test_row_local_rewriting_streams(spark, tmp_path):
    df = spark.createDataFrame([("en", "an idiot here")], "lang string, text string")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    query = (
        rw.delete_inline(stream, TERMS).writeStream.format("parquet")
        .option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp"))
        .trigger(availableNow=True).start()
    )
    query.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).collect()[0]["prediction"] == "an here"


@pytest.mark.parametrize("limit", [0, 1 << 30])
def test_null_and_repeated_ids(spark, monkeypatch, limit):
    monkeypatch.setattr(rw, "LEXICON_BYTES", limit)
    lexicon = spark.createDataFrame([("en", "idiot"), ("es", "tonto")], "lang string, term string")
    rows = [(None, "en", "you idiot there"), (None, "en", "you idiot there"), (1, "en", "idiot tonto one"), (1, "es", "idiot tonto one"),
            (1, "en", "tonto two"), (1, "es", "idiot two"), (None, "es", "un tonto"), (2, "en", None), (3, "en", "")]
    want = ["you there", "you there", "tonto one", "idiot one", "tonto two", "idiot two", "un", None, ""]
    df = spark.createDataFrame(rows, "row_id long, lang string, text string")
    got = rw.delete_terms(df, lexicon, "row_id", match="exact")
    assert got.columns == ["row_id", "lang", "text", "prediction"]
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, got.collect()), key=key) == sorted(((*r, w) for r, w in zip(rows, want)), key=key)
    counted = rw.count_flagged(df, lexicon, "row_id").groupBy().sum("n_flagged").first()[0]
    assert counted == 5
