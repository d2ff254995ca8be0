"""Secret scans with multipart linking; DataFrame functions only.

Patterns run once over each text and leave lengths of matches and of what lies between
them.  Those few numbers are exploded and summed up to positions.  Strong kinds are
reported as they are.  Weak candidates (a bare key-like word, an identifier, an endpoint)
are common in clean texts, so they are reported only where an interval join finds a
complementary part within the same scope: an access key without its secret is of no use,
nor is a secret without what it opens.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mildtext.llm.common import written
from mildtext.session import sized

# The base kinds, in the order of ties.  (name, pattern, group that counts, its least length)
BASE = (
    ("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    # runs of the same letters, tried only from their first letter on
    ("hex", r"(?<![0-9a-f])[0-9a-f]{24,}+", 0, 24),
)
# Weak kinds, reported when linked.
WEAK = (
    ("key", r"(?<![A-Za-z0-9+/=_-])(?=[A-Za-z+/]{0,39}[0-9])(?=[a-z0-9+/]{0,39}[A-Z])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=_-])", 0, 40),
    ("identity", r"""(?i:access_?key_?id|client_?id|account|user(?:_?name)?|login)["']?\x20*[:=]\x20*["']?([A-Za-z0-9_.@-]+)""", 1, 3),
    ("endpoint", r"(?<![A-Za-z0-9+.-])[A-Za-z][A-Za-z0-9+.-]{1,15}+://[^\s\"'<>]+", 0, 8),
)
KINDS = BASE + WEAK
NAMES = tuple(k[0] for k in KINDS)
# What a part is, and which parts make it whole.
ROLE = {"assign": "secret", "access": "identity", "hex": "secret", "key": "secret", "identity": "identity", "endpoint": "endpoint"}
COMPLEMENT = {"secret": ("identity", "endpoint"), "identity": ("secret",), "endpoint": ("secret",)}
# Code points that may lie between two parts of one scope.
SCOPE = 256


def _lengths(text: Column, pattern: str, group: int) -> Column:
    """Matches of a pattern as an array of (length before, length, length of the group).

    Leftmost, non-overlapping, in code points; ``before`` counts from the last match's end.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    inner = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    triples = F.zip_with(
        F.zip_with(F.slice(F.split(text, pattern, -1), 1, F.size(found)), found, lambda a, b: F.struct(F.length(a).alias("a"), F.length(b).alias("b"))),
        inner,
        lambda x, g: F.struct(x["a"].alias("before"), x["b"].alias("length"), F.length(g).alias("inner")),
    )
    return F.when(text.rlike(pattern), triples)


def matches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``row`` (a number of its own), the id, and a column of lengths
    per kind (null: no match).  Written once, so the patterns run once; no text is kept.

    A null text counts as empty.
    """
    text = F.coalesce(F.col("__text"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").alias(id_col), F.col(f"`{text_col}`").alias("__text"))
    found = rows.select(
        F.monotonically_increasing_id().alias("row"), id_col, *[_lengths(text, p, g).alias(f"m_{name}") for name, p, g, _ in KINDS]
    )
    return written(found)


def spans(found: DataFrame) -> DataFrame:
    """``row``, ``kind`` (its number), ``start``, ``end`` of every match that is long enough, weak ones too.

    Positions are running sums within a row and kind; matches that fail still move them on.
    """
    own = F.array(*[F.struct(F.lit(n).alias("kind"), F.col(f"m_{name}").alias("m")) for n, name in enumerate(NAMES)])
    some = F.coalesce(*[F.col(f"m_{name}") for name in NAMES]).isNotNull()
    each = (
        found.filter(some)
        .select("row", F.explode(own).alias("x"))
        .select("row", "x.kind", F.posexplode("x.m").alias("n", "m"))
    )
    so_far = Window.partitionBy("row", "kind").orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(F.col("m.before") + F.col("m.length")).over(so_far)
    least = F.array(*[F.lit(k[3]) for k in KINDS])
    placed = each.select("row", "kind", "m", end.alias("end"))
    return placed.filter(F.col("m.inner") >= F.get(least, F.col("kind"))).select(
        "row", "kind", (F.col("end") - F.col("m.length")).alias("start"), "end"
    )


def _in_bins(parts: DataFrame, reach: int, scope: int) -> DataFrame:
    """A row for each bin of ``scope`` code points that a part, widened by ``reach``, touches."""
    first, last = F.floor((F.col("start") - reach) / scope), F.floor((F.col("end") + reach) / scope)
    return parts.withColumn("bin", F.explode(F.sequence(first, last)))


def linked(parts: DataFrame, scope: int = SCOPE) -> DataFrame:
    """The parts to report: strong ones, and weak ones that a complementary part is close to.

    Weak parts that overlap a strong one say nothing new and are not reported, but others
    may still find their complement in them.  The interval
    join meets parts in bins of one scope, so no part is compared beyond its
    neighbourhood, however many a text holds; a semi-join gives no pairs.
    """
    strong = F.col("kind") < len(BASE)
    firm = parts.filter(strong)
    role = F.get(F.array(*[F.lit(ROLE[n]) for n in NAMES]), F.col("kind"))
    other = _in_bins(firm, 0, scope).select(
        F.col("row").alias("o_row"), F.col("bin").alias("o_bin"), F.col("start").alias("o_start"), F.col("end").alias("o_end")
    )
    same = (F.col("row") == F.col("o_row")) & (F.col("bin") == F.col("o_bin"))
    overlap = (F.col("start") < F.col("o_end")) & (F.col("o_start") < F.col("end"))
    hidden = _in_bins(parts.filter(~strong), 0, scope).join(other, same & overlap, "left_semi").select("row", "kind", "start").distinct()
    weak = parts.filter(~strong).join(hidden, ["row", "kind", "start"], "left_anti").withColumn("role", role)
    near = _in_bins(parts.withColumn("role", role), scope, scope).select(
        F.col("row").alias("o_row"), F.col("bin").alias("o_bin"), F.col("start").alias("o_start"), F.col("end").alias("o_end"), F.col("role").alias("o_role")
    )
    whole = F.lit(False)
    for own, others in COMPLEMENT.items():
        whole = whole | ((F.col("role") == own) & F.col("o_role").isin(*others))
    close = (F.col("o_start") - F.col("end") <= scope) & (F.col("start") - F.col("o_end") <= scope)
    met = _in_bins(weak, 0, scope).join(near, same & whole & close, "left_semi")
    return firm.unionByName(met.select("row", "kind", "start", "end").distinct())


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = SCOPE) -> DataFrame:
    """The id and ``spans`` (array of kind, start, end, by start, then in the order of kinds) of every row.

    Code points, end exclusive.  Rows without a match, null and empty texts have an empty
    array; repeated rows have theirs each; other columns of ``docs`` are not read.
    """
    found = matches(docs, id_col, text_col)
    names = F.array(*[F.lit(n) for n in NAMES])
    own = (
        linked(written(spans(found)), scope)
        .groupBy("row")
        .agg(F.sort_array(F.collect_list(F.struct("start", "kind", "end"))).alias("s"))  # the spans of one text
        .select("row", F.transform("s", lambda x: F.struct(F.get(names, x["kind"]).alias("kind"), x["start"].alias("start"), x["end"].alias("end"))).alias("spans"))
    )
    none = F.array().cast("array<struct<kind:string,start:bigint,end:bigint>>")
    return found.select("row", id_col).join(own, "row", "left").select(id_col, F.coalesce("spans", none).alias("spans"))


def _joined(spans_col: Column) -> Column:
    return F.array_join(F.transform(spans_col, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def digests(scanned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts of the base kinds, the digest of their spans, and all spans as text."""
    base = F.filter("spans", lambda x: x["kind"].isin(*[k[0] for k in BASE]))

    def number(kind: str) -> Column:
        return F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    counts = [number(k[0]) for k in BASE]
    return scanned.select(
        id_col, *counts, F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans")
    )


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = SCOPE) -> DataFrame:
    """``docs`` with every reported span of a text replaced by its kind in brackets.

    Overlapping spans become one, under the name of the first.  Row for row the same
    columns; ids must be unique among rows that differ in their text.  Texts without a
    span stay as they are, nulls too.
    """
    # a digest beside the id, so that a repeated id does not mix texts
    mark = F.xxhash64(F.coalesce(F.col(f"`{text_col}`"), F.lit("")))
    keyed = docs.select(F.struct(F.col(f"`{id_col}`").alias("id"), mark.alias("text")).alias("__key"), F.col(f"`{text_col}`").alias("__text"))
    found = scan(keyed, "__key", "__text", scope).filter(F.size("spans") > 0)
    found = found.groupBy(F.col("__key.id").alias("__id"), F.col("__key.text").alias("__mark")).agg(F.first("spans").alias("__spans"))
    found = sized(written(found))  # few texts hold secrets; if their spans are small, no text is shuffled
    text = F.col(f"`{text_col}`")
    start = F.struct(F.lit("").alias("done"), F.lit(0).cast("bigint").alias("at"))
    cut = F.aggregate(
        "__spans",
        start,
        lambda a, x: F.when(
            x["start"] >= a["at"],
            F.struct(
                F.concat(a["done"], F.substring(text, (a["at"] + 1).cast("int"), (x["start"] - a["at"]).cast("int")), F.lit("["), x["kind"], F.lit("]")).alias("done"),
                x["end"].alias("at"),
            ),
        ).otherwise(F.struct(a["done"].alias("done"), F.greatest(a["at"], x["end"]).alias("at"))),
        lambda a: F.concat(a["done"], F.substring(text, (a["at"] + 1).cast("int"), F.length(text))),
    )
    joined = docs.withColumn("__m", mark).join(
        found, F.col(f"`{id_col}`").eqNullSafe(F.col("__id")) & (F.col("__m") == F.col("__mark")), "left"
    )
    out = F.when(F.col("__spans").isNotNull(), cut).otherwise(text)
    return joined.select(*[out.alias(text_col) if c == text_col else F.col(f"`{c}`") for c in docs.columns])
