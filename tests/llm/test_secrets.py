import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from mildtext.llm import secrets
from mildtext.llm.queries import op4_secret_scan

SF = "/root/testdata/sf0.001"
# as stated, in another engine's notation
BASE = {
    "assign": (r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6),
    "access": (r"AKIA[A-Z0-9]+", 0, 20),
    "hex": (r"[0-9a-f]+", 0, 24),
}
SECRET = "wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY"


def base(text):
    out = []
    for n, (kind, (pattern, group, least)) in enumerate(BASE.items()):
        out += [(m.start(), n, f"{kind}:{m.start()}:{m.end()}") for m in re.finditer(pattern, text or "") if len(m[group]) >= least]
    return [x[2] for x in sorted(out)]


def check(row, text):
    want = base(text)
    assert row.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
    assert [row.n_assign, row.n_access, row.n_hex] == [sum(x.startswith(k) for x in want) for k in BASE]
    assert [s for s in row.spans.split(",") if s.split(":")[0] in BASE] == want


def test_query(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = op4_secret_scan(spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        check(r, texts[r.doc_id])


def test_base_spans_on_random_texts(spark):
    pick = random.Random(11)
    parts = ["token", "TOKEN", "api_key", "apikey", "ſecret", "passwd", "password", "=", ":", " ", "  ", '"', "'", "abc", "abcdef0123", "AKIA", "AKIA" + "Z9" * 9,
             "0" * 13, "f" * 23, "f", "é", "\U0001f600", "\n", ".", "token=token:abcdefgh", "secret="]
    texts = ["".join(pick.choices(parts, k=pick.randint(0, 25))) for _ in range(400)] + [None, "", "token=" + "a" * 100_000, "ab " * 50_000]
    df = spark.createDataFrame([(i, t, 5) for i, t in enumerate(texts)], "doc_id long, text string, spans int").repartition(4)
    got = {r.doc_id: r for r in secrets.digests(secrets.scan(df)).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        check(got[i], t)


@pytest.mark.parametrize("text, kinds", [
    (f"x {SECRET} y", []),  # alone it may be anything
    (f"user: alice {SECRET} y", ["identity", "key"]),
    (f"AKIA{'A1' * 8} {SECRET}", ["access", "key"]),
    (f"user=alice {'z ' * 200} {SECRET}", []),  # too far apart
    ("see https://example.com/a for more, user: bob", []),
    ("see https://example.com/a for more", []),
    ("db://host:1/x password=hunter22", ["endpoint", "assign"]),
    (f"secret={SECRET}", ["assign"]),  # not reported twice
    ("login: eve", []),
    (f"https://host/x?token=abcdef123 {SECRET}", ["assign", "key"]),  # the endpoint is not reported, but there
])
def test_weak_parts_need_complements(spark, text, kinds):
    df = spark.createDataFrame([(1, "é\U0001f600 " + text)], "doc_id long, text string")
    (row,) = secrets.scan(df).collect()
    assert [s["kind"] for s in row.spans] == kinds


def test_links_are_those_of_brute_force(spark):
    pick = random.Random(4)
    rows = []
    for row in range(30):
        at = 0
        for _ in range(pick.randint(0, 40)):
            at += pick.randint(0, 400)
            end = at + pick.choice([8, 40, 700])
            rows.append((row, pick.randrange(len(secrets.NAMES)), at, end))
            at = end if pick.random() < 0.8 else at + 1
    df = spark.createDataFrame(rows, "row long, kind int, start long, end long")
    got = {tuple(r) for r in secrets.linked(df).collect()}
    n = len(secrets.BASE)
    want = {r for r in rows if r[1] < n}
    weak = [r for r in rows if r[1] >= n and not any(o[0] == r[0] and r[2] < o[3] and o[2] < r[3] for o in want)]
    role = [secrets.ROLE[k] for k in secrets.NAMES]
    for r in weak:
        if any(o[0] == r[0] and role[o[1]] in secrets.COMPLEMENT[role[r[1]]] and o[2] - r[3] <= 256 and r[2] - o[3] <= 256 for o in rows if o[0] == r[0] and o != r):
            want = want | {r}
    assert got == want


def test_redact(spark):
    rows = [(1, "é token=abcdefgh, f" + "0" * 30, "en"), (1, "plain", "en"), (None, None, "en"), (2, "", None), (1, "plain", "en"), (3, "token=AKIA" + "A" * 20, "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = sorted((str(r.text) for r in secrets.redact(df).collect()))
    assert got == sorted(["é [assign], [hex]", "plain", "None", "", "plain", "[assign]"])
    assert secrets.redact(df).columns == df.columns
    assert secrets.scan(df.filter(F.lit(False))).count() == 0


def test_no_python_in_the_plan(spark):
    plan = op4_secret_scan(spark, SF)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
