import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from mildtext.llm import chat
from mildtext.llm.queries import op10_chat_format

SF = "/root/testdata/sf0.001"


def text_of(template, **data):
    return "".join(t for t, _ in chat.compiled(template)(data))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([*chat.CONTROLS, "\\", "<", "|", "a", "\n", "[", "[/", "<\\|end|>"]), max_size=12))
def test_escape_is_reversible(parts):
    text = "".join(parts)
    assert chat.unescape(chat.escape(text)) == text
    assert not any(c in chat.escape(text) for c in chat.CONTROLS)


def test_language():
    loop = "{% for m in ms %}{% if m.a == 'x' and not m.b %}X{% elif m.a != 'y' or false %}?{{ m.a | upper ~ '!' }}{% else %}Y{% endif %},{% endfor %}"
    ms = [{"a": "x"}, {"a": "x", "b": 1}, {"a": "y"}, {"a": "q"}]
    assert text_of(loop, ms=ms) == "X,?X!,Y,?Q!,"
    assert text_of("a{{ none.such }}b{{ 1 }}") == "ab1"
    for bad in ("{% for x %}", "{% if a %}", "{{ a | open }}", "{{ a._b }}", "{{ __import__ }}", "{% endfor %}", "{{ a() }}", "{{ 'a }}", "{{ (a }}"):
        with pytest.raises(chat.TemplateError):
            chat.parse(bad)


def test_constants_are_folded():
    assert chat.parse("a{{ 'b' ~ 'c' | upper }}{% if 1 == 1 %}d{% else %}{{ x }}{% endif %}{% if false %}{{ x }}{% endif %}e") == [("text", "abCde")]


def expected(turns):
    said = "".join(f"{r or ''}\n{t or ''}\n" for r, t in turns)
    loss = "".join(t or "" for r, t in turns if r == "assistant")
    return len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


def test_query(spark):
    rows = spark.read.parquet(f"{SF}/conversations.parquet").orderBy("conv_id", "turn").collect()
    turns = {}
    for r in rows:
        turns.setdefault(r.conv_id, []).append((r.role, r.text))
    turns[-7] = [("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")]
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in op10_chat_format(spark, SF).collect()}
    assert got == {c: expected(t) for c, t in turns.items()}


def test_edge_rows(spark):
    rows = [(1, 0, None, None, "x"), (1, 1, "assistant", "", "x"), (1, 1, "assistant", "b<|end|>\n", "x"), (1, 1, "assistant", "a\\", "x"),
            (None, 3, "user", "q", "x"), (None, None, "assistant", "z" * 100_000, "x"), (2, 0, "ro<|text|>le\n", "t", "x"), (2, 0, "ro<|text|>le\n", "t", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    formatted = chat.format_conversations(df)
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.read_back(formatted).collect()}
    assert got == {
        1: expected([(None, None), ("assistant", ""), ("assistant", "a\\"), ("assistant", "b<|end|>\n")]),
        None: expected([("assistant", "z" * 100_000), ("user", "q")]),
        2: expected([("ro<|text|>le\n", "t")] * 2),
    }
    assert formatted.agg(F.sum(F.length("formatted"))).first()[0] == chat.read_back(formatted).agg(F.sum("formatted_chars")).first()[0]
    assert chat.read_back(chat.format_conversations(df.limit(0))).count() == 0
    with pytest.raises(Exception, match="no turn"):
        chat.read_back(chat.format_conversations(df, "{{ 'plain' }}")).collect()
