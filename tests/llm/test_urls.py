import random
import re
from collections import Counter, defaultdict
from itertools import combinations

from pyspark.sql import functions as F

from mildtext.llm import urls
from mildtext.llm.queries import URL_RULES, op8_url_filter

SF = "/root/testdata/sf0.001"


def parts(url):
    after = url.partition("://")[2] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", after)[0]
    path = re.match(r"[^?#]*", after[len(host):])[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def fixed(host, path):
    fits = [(len(h + p), h + p, v) for v, h, p in URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


def test_query(spark):
    rows = spark.read.parquet(f"{SF}/pages.parquet").collect()
    got = {r.page_id: r for r in op8_url_filter(spark, SF).collect()}
    assert len(got) == len(rows)
    for r in rows:
        g = got[r.page_id]
        assert (g.host, g.path) == parts(r.url)
        rule, verdict = fixed(g.host, g.path)
        assert g.rule == rule
        assert g.verdict == (verdict or g.verdict) and g.verdict in ("allow", "block")


def test_edge_urls(spark):
    given = [None, "", "no scheme/x", "HTTP://A.NET", "http://a.net/", "http://net/x", "http://xnet/x", "x://Éa.Org/fr/?q#f",
             "http://sub.example.net/en/1", "http://sub.example.net/eN/1", "http://example.com/de/", "http://a.b?x/fr/", "a://b://c/d", "http://h#/p",
             "http://org/fr/" + "x" * 100_000]
    df = spark.createDataFrame([(i % 9, u, "h") for i, u in enumerate(given)], "page_id long, url string, host string")
    got = urls.judge(df, URL_RULES).collect()
    want = []
    for i, u in enumerate(given):
        h, p = parts(u)
        want.append((i % 9, h, p, *fixed(h, p)))
    key = lambda r: (r[0], r[1], len(r[2]), r[2][:50])
    got = sorted(got, key=key)
    for g, w in zip(got, sorted(want, key=key), strict=True):
        assert tuple(g)[:4] == w[:4] and g.verdict == (w[4] or g.verdict)
    assert urls.judge(df.limit(0), URL_RULES).count() == 0


def test_mined_rules_are_those_of_brute_force(spark):
    pick = random.Random(2)
    sites = ["spam-farm.example.org", "a.example.org", "b.example.com"]
    rows = []
    for _ in range(400):
        site, lang = pick.choice(sites), pick.choice(["en", "fr"])
        bad = site.startswith("spam") or (site.startswith("b.") and lang == "fr")
        rows.append((f"http://{site}/{lang}/{pick.randint(1, 999)}", "block" if bad else "allow"))
    df = spark.createDataFrame(rows, "url string, verdict string")
    settings = urls.Mining(min_support=0.05, min_confidence=0.95)
    rules = urls.mine(df, settings)
    own = [(set(t), v) for t, v in df.select(urls.tokens(F.col("url")), "verdict").collect()]
    for items, verdict, confidence, n in rules:
        fit = [v for t, v in own if items <= t]
        assert n == fit.count(verdict) >= 0.05 * len(rows)
        assert abs(confidence - fit.count(verdict) / len(fit)) < 1e-9 and confidence >= 0.95
    index = urls.Index(rules)
    for t, v in own:
        brute = [r[1] for r in rules if r[0] <= t]
        assert index.verdict(t) == (brute[0] if brute else None) == v
    assert index.verdict(set()) is None
    assert urls.mine(df.limit(0)) == []


def test_sure_rules_leave_room_for_less_sure_ones(spark):
    rows = [(f"http://s{i}.k{i}.x/" + "/".join(f"{c}{'z' * i}" for c in "abcdef"), "allow") for i in range(8) for _ in range(30)]
    rows += [("http://n.y.w/q", "block")] * 19 + [("http://n.y.w/q", "allow")]
    rules = urls.mine(spark.createDataFrame(rows, "url string, verdict string"))
    found = {r[0]: r[1:] for r in rules}
    assert len(found) == len(rules)
    for token in ("host:n", "host:y", "host:w", "site:y.w", "path:q"):
        assert found[frozenset([token])] == ("block", 0.95, 19)
    for own in found:  # no superset of a rule that is as sure
        assert not any(other < own and found[other][0] == found[own][0] and found[other][1] >= found[own][1] for other in found)
    assert urls.Index(rules).verdict({"host:n", "path:other"}) == "block"


def brute_rules(own, needed, least):
    """All rules of at least that support and confidence that none with one token less is as sure as."""
    counts = defaultdict(Counter)
    for tokens, verdict in own:
        for k in range(1, len(tokens) + 1):
            for items in combinations(sorted(tokens), k):
                counts[items][verdict] += 1
    sure = {(i, v): (n / c.total(), n) for i, c in counts.items() for v, n in c.items() if n >= needed and n / c.total() >= least}
    return {
        (frozenset(i), v, c, n)
        for (i, v), (c, n) in sure.items()
        if not any(sure.get((i[:k] + i[k + 1 :], v), (0,))[0] >= c for k in range(len(i)))
    }


def test_whole_urls_are_mined(spark):
    pick = random.Random(4)
    rows = []
    for _ in range(300):
        keys = [k for k in "abcdefgh" if pick.random() < 0.6] + (["x", "y"] if pick.random() < 0.5 else [])
        bad = ("a" in keys and "h" in keys) != (pick.random() < 0.06)
        url = f"http://{pick.choice('st')}.w.v/p?" + "&".join(f"{k}=1" for k in keys) + pick.choice(["", "#f"])
        rows.append((url, "block" if bad else "allow"))
    rows += [(f"http://only.u/{n}", "allow") for n in "1234567"]
    df = spark.createDataFrame(rows, "url string, verdict string")
    own = [(set(t), v) for t, v in df.select(urls.tokens(F.col("url")), "verdict").collect()]
    assert max(len(t) for t, _ in own) > 14
    for settings in (urls.Mining(0.02, 0.9), urls.Mining(0.1, 0.3)):
        rules = urls.mine(df, settings)
        want = brute_rules(own, settings.min_support * len(rows), settings.min_confidence)
        assert len(rules) == len(want) and set(rules) == want
        assert rules == sorted(rules, key=lambda r: (-r[2], -r[3], len(r[0]), sorted(r[0])))


def test_many_tokens(spark):
    letters = "abcdefghijklmnopqrst"
    words = ["w" + a + b for a in letters for b in letters]
    rows = [(f"http://h/{w}", "block" if i % 2 else "allow") for i, w in enumerate(words) for _ in range(2)]
    long = ["l" + a + b for a in "ab" for b in letters]
    rows += [("http://h/" + "/".join(long), v) for v in ["block"] * 18 + ["allow"]]
    found = {r[0]: r[1] for r in urls.mine(spark.createDataFrame(rows, "url string, verdict string"))}
    want = {w: "block" if i % 2 else "allow" for i, w in enumerate(words)} | dict.fromkeys(long, "block")
    assert found == {frozenset(["path:" + w]): v for w, v in want.items()}
    assert urls.mine(spark.createDataFrame(rows[:1], "url string, verdict string")) == []


def test_undecided_urls_by_mined_rules(spark):
    rows = [(i, f"http://spam-farm.x.net/{i}/{s}") for i, s in enumerate("abcdefgh")]
    rows += [(100 + i, f"http://good.example.net/en/{s}") for i, s in enumerate("abcdefgh")]
    rows += [(200, "http://spam-farm.x.info/9/z"), (201, "http://good.info/en/z")]
    got = {r.page_id: (r.rule, r.verdict) for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string"), URL_RULES).collect()}
    assert got[200] == (None, "block") and got[201] == (None, "allow") and got[100] == ("example.net/en/", "allow")
