"""URL filters by association rules.

Fixed host-and-path rules decide first.  For the other URLs, Spark's FP-growth mines token combinations that
go with a verdict out of labelled URLs; rules are pruned by support and confidence, and by
every more general rule that is as sure.  URLs meet the rules through an inverted index
from token to rules, inside one projection.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import product

import pyarrow as pa
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mildtext.llm.common import written

ALLOW, BLOCK = "allow", "block"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Mining:
    """Parameters of the mining.

    ``min_support`` and ``min_confidence`` prune rules; nothing else bounds them.  Combinations
    grow as 2 to the power of the tokens that go together in ``min_support`` of the URLs, not
    counting tokens of one verdict only, and counting tokens of the same URLs once.
    """

    min_support: float = 0.002
    min_confidence: float = 0.9


def host(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; null or no ``://``: empty."""
    return F.translate(_part(url, r"^([^/?#]*)"), _UPPER, _LOWER)


def path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; null or no ``://``: empty."""
    return _part(url, r"^[^/?#]*([^?#]*)")


def _part(url: Column, pattern: str) -> Column:
    at = F.locate("://", url)
    after = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    return F.regexp_extract(F.coalesce(after, F.lit("")), pattern, 1)


def fixed_rule(host_col: Column, path_col: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """The longest fitting rule as a struct (rule, verdict), null if none fits.

    ``rules`` holds (verdict, host, path): a rule fits its host and all subdomains if the
    path starts with the rule's.  Of two rules of one length the first counts.
    """
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, own_host, own_path in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((host_col == own_host) | host_col.endswith("." + own_host)) & path_col.startswith(own_path)
        value = F.struct(F.lit(own_host + own_path).alias("rule"), F.lit(verdict).alias("verdict"))
        found = F.when(fits, value).otherwise(found)
    return found


def tokens(url: Column) -> Column:
    """Distinct tokens: host labels, host suffixes of two labels, path segments, names of
    parameters, scheme and fragment marks; digits of a segment as ``0``."""
    labels = F.filter(F.split(host(url), r"\."), lambda x: x != "")
    segments = F.filter(F.split(F.lower(path(url)), "/"), lambda x: x != "")
    query = F.split(F.regexp_extract(url, r"\?([^#]*)", 1), "&")
    names = F.filter(F.transform(query, lambda p: F.substring_index(p, "=", 1)), lambda x: x != "")
    parts = [
        F.transform(labels, lambda x: F.concat(F.lit("host:"), x)),
        F.when(F.size(labels) > 1, F.array(F.concat(F.lit("site:"), F.array_join(F.slice(labels, -2, 2), "."))))
        .otherwise(F.array().cast("array<string>")),
        F.transform(segments, lambda x: F.concat(F.lit("path:"), F.regexp_replace(x, r"\d+", "0"))),
        F.transform(names, lambda x: F.concat(F.lit("key:"), x)),
        F.array(F.concat(F.lit("scheme:"), F.lower(F.substring_index(url, ":", 1)))),
        F.when(url.contains("#"), F.array(F.lit("fragment:"))).otherwise(F.array().cast("array<string>")),
    ]
    return F.array_distinct(F.concat(*parts))


def mine(labelled: DataFrame, settings: Mining = Mining()) -> list[tuple[frozenset[str], str, float, int]]:
    """Rules (tokens, verdict, confidence, support in URLs) out of ``url`` and ``verdict`` columns.

    Best first: by confidence, support, then tokens.  Null URLs and verdicts are left out;
    no labelled URLs: no rules.
    """
    rows = labelled.filter("url is not null and verdict is not null").select(
        F.monotonically_increasing_id().alias("row"), "verdict", tokens(F.col("url")).alias("own")
    )
    total = rows.count()
    needed = max(2, math.ceil(settings.min_support * total))
    if total < needed:
        return []
    # at most tokens of a URL / min_support; ``urls`` is equal for tokens of the same URLs
    by_verdict = rows.select("row", "verdict", F.explode("own").alias("token")).groupBy("token", "verdict").agg(
        F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("row")).alias("x"), F.bit_xor(F.xxhash64("row", F.lit("y"))).alias("y")
    )
    counts = by_verdict.groupBy("token").agg(
        F.sum("n").alias("of"), F.max("n").alias("n"), F.max_by("verdict", "n").alias("verdict"),
        F.sort_array(F.collect_list(F.struct("verdict", "n", "x", "y"))).alias("urls"),
    )
    rules: list[tuple[frozenset[str], str, float, int]] = []
    same: dict[tuple, list[str]] = defaultdict(list)
    for r in counts.filter(F.col("n") >= needed).collect():
        if r["n"] == r["of"]:  # always one verdict: all rules with more tokens are redundant
            rules.append((frozenset([r["token"]]), r["verdict"], 1.0, r["n"]))
        else:
            same[tuple(map(tuple, r["urls"]))].append(r["token"])
    # two tokens of the same URLs in one rule are redundant; one stands for all of them
    classes = {min(own): own for own in same.values()}
    stands = {t: name for name, own in classes.items() for t in own}

    def shortened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            verdicts, all_own = (batch.column(c).to_pylist() for c in ("verdict", "own"))
            items = [[*sorted({stands[t] for t in own if t in stands}), "verdict:" + v] for v, own in zip(verdicts, all_own)]
            yield pa.RecordBatch.from_arrays([pa.array(items, pa.list_(pa.string()))], ["items"])

    baskets = rows.select("verdict", "own").mapInArrow(shortened, "items array<string>")
    # equal baskets are many: FP-growth merges them in its trees
    model = FPGrowth(minSupport=(needed - 0.5) / total, minConfidence=settings.min_confidence).fit(baskets)
    mark = F.filter("items", lambda t: t.startswith("verdict:"))
    sets = written(
        model.freqItemsets.select(
            F.array_sort(F.array_except("items", mark)).alias("own"),
            F.substring_index(F.get(mark, 0), ":", -1).alias("verdict"), F.col("freq").alias("n"),
        ).filter(F.size("own") > 0)
    )
    of = sets.filter("verdict is null").select("own", F.col("n").alias("of"))
    sure = F.col("n") / F.col("of") >= settings.min_confidence
    kept = pruned(written(sets.filter("verdict is not null").join(of, "own").filter(sure))).collect()
    for r in kept:
        rules += [(frozenset(own), r["verdict"], r["n"] / r["of"], r["n"]) for own in product(*[classes[t] for t in r["own"]])]
    return sorted(rules, key=lambda r: (-r[2], -r[3], len(r[0]), sorted(r[0])))


def pruned(rules: DataFrame) -> DataFrame:
    """``rules`` (``own``: sorted tokens, ``verdict``, ``n`` of ``of`` URLs) without those that a rule
    of the same verdict and one token less is as sure as."""
    shorter = rules.filter(F.size("own") > 1).select(
        "own", "verdict", "n", "of", F.explode(F.transform("own", lambda t: F.array_except("own", F.array(t)))).alias("less")
    )
    general = rules.select(F.col("own").alias("less"), F.col("verdict").alias("g_verdict"), F.col("n").alias("g_n"), F.col("of").alias("g_of"))
    as_sure = (F.col("verdict") == F.col("g_verdict")) & (F.col("g_n") * F.col("of") >= F.col("n") * F.col("g_of"))
    redundant = shorter.alias("s").join(general.alias("g"), (F.col("s.less") == F.col("g.less")) & as_sure, "left_semi")
    return rules.join(redundant.select("own", "verdict").distinct(), ["own", "verdict"], "left_anti")


class Index:
    """Inverted index from token to rules: a rule is tried only if its rarest token is there."""

    def __init__(self, rules: list[tuple[frozenset[str], str, float, int]]) -> None:
        uses: dict[str, int] = defaultdict(int)
        for own, *_ in rules:
            for token in own:
                uses[token] += 1
        self.rules = rules
        self.by_token: dict[str, list[int]] = defaultdict(list)
        for n, (own, *_) in enumerate(rules):
            self.by_token[min(own, key=lambda t: (uses[t], t))].append(n)

    def verdict(self, own: set[str]) -> str | None:
        """Verdict of the best rule whose tokens are all there."""
        hits = [n for t in own for n in self.by_token.get(t, ()) if self.rules[n][0] <= own]
        return self.rules[min(hits)][1] if hits else None


def judge(
    pages: DataFrame, fixed: Sequence[tuple[str, str, str]], settings: Mining = Mining(),
    id_col: str = "page_id", url_col: str = "url", labelled: DataFrame | None = None,
) -> DataFrame:
    """``host``, ``path``, ``rule`` and ``verdict`` of every row, beside its id.

    ``rule`` is the fixed rule or null.  Without a fixed rule the mined rules decide, and
    where none of them fits the verdict is allow.  ``labelled`` (``url``, ``verdict``)
    defaults to the URLs that the fixed rules decide.  Null, empty and repeated URLs or
    ids keep their rows; null URLs have empty host and path and are allowed.
    """
    url = F.col("url")
    rows = pages.select(pages[id_col].alias("id"), pages[url_col].alias("url"))
    rows = rows.withColumns({"host": host(url), "path": path(url)})
    rows = rows.withColumn("fixed", fixed_rule(F.col("host"), F.col("path"), fixed))
    if labelled is None:
        labelled = rows.filter("fixed is not null").select("url", "fixed.verdict")
    rules = mine(labelled, settings)
    index: list[Index] = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not index:
            index.append(Index(rules))
        known: dict[tuple, str | None] = {}
        for batch in batches:
            known.clear()
            found = []
            for own in batch.column("own").to_pylist():
                if own is None:
                    found.append(None)
                    continue
                key = tuple(own)
                if key not in known:
                    known[key] = index[0].verdict(set(own))
                found.append(known[key])
            columns = [batch.column(c) for c in ("id", "host", "path", "rule", "verdict")]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(found, pa.string())], ["id", "host", "path", "rule", "verdict", "mined"]
            )

    undecided = F.when(F.col("fixed").isNull() & url.isNotNull(), tokens(url))
    judged = rows.select("id", "host", "path", "fixed.rule", "fixed.verdict", undecided.alias("own")).mapInArrow(
        run, f"id {pages.schema[id_col].dataType.simpleString()}, host string, path string, rule string, verdict string, mined string"
    )
    verdict = F.coalesce("verdict", "mined", F.lit(ALLOW))
    return judged.select(F.col("id").alias(id_col), "host", "path", "rule", verdict.alias("verdict"))
