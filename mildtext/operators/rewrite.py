"""Lexicon matching and the rule-based rewriters.

A token matches a lexicon of its language if its cleaned form

* is a term (``exact``), or
* (``prefix``) has at least four characters and starts with a term of at least
  four characters, or is the start of such a term.

The lexicon of a language is its list in the base lexicon, or the union of all base lists if it
has none, and the extra terms of that language.

Physical forms of the same result:

* *inline* - terms given as lists in the program become sets inside one expression.
* *each* - the same for several lists at once: a vectorised function cuts a text into tokens once, and asks
  for every different token once.
* *shared* - a lexicon whose measured size allows it goes to the tasks as hash sets, and a
  text is rewritten where it is: a projection, whatever the number of terms.
* *joined* - beyond that size, distinct tokens of the corpus meet the lexicon in equi-joins,
  and the flagged tokens travel back to the texts that have any.
"""

from __future__ import annotations

import functools
import sys
from collections.abc import Callable, Iterable, Iterator, Mapping
from itertools import compress

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mildtext.functions import text as tx
from mildtext.operators.once import once
from mildtext.operators.skew import key_counts, lookup
from mildtext.session import materialize, measured_bytes, sized, small_batches
from mildtext.sources.lexicon import all_language_terms

MIN_PREFIX = 4
# Measured size up to which a lexicon is shared with every task.
LEXICON_BYTES = 32 * 1024 * 1024
# Tokens whose answer a task remembers.
REMEMBERED = 200_000
# Scope of the texts whose language has no list of its own; no language label is empty after cleaning.
ELSEWHERE = "\x00"

Terms = Mapping[str, Iterable[str]]


# --- lexicon against tokens -------------------------------------------------


def collect_terms(lexicon: DataFrame) -> dict[str, list[str]]:
    """The lexicon as lists; for lexicons of a checked size."""
    terms: dict[str, set[str]] = {}
    for row in lexicon.select("lang", "term").collect():
        terms.setdefault(row["lang"], set()).add(row["term"])
    return {lang: sorted(group) for lang, group in sorted(terms.items())}


class Matcher:
    """Does a cleaned token match a fixed set of terms?  A few hash lookups, whatever their number."""

    def __init__(self, terms: Iterable[str], match: str) -> None:
        if match not in ("exact", "prefix"):
            raise ValueError(f"unknown match mode: {match}")
        self.whole = set(terms)
        long_terms = {t for t in self.whole if len(t) >= MIN_PREFIX} if match == "prefix" else set()
        self.long_terms = long_terms
        self.starts = {t[:n] for t in long_terms for n in range(MIN_PREFIX, len(t))}
        self.lengths = sorted({len(t) for t in long_terms})

    def __call__(self, token: str) -> bool:
        if token in self.whole or token in self.starts:
            return True
        return any(token[:n] in self.long_terms for n in self.lengths if n < len(token))


def scoped_matchers(base: Terms, extra: Terms, match: str) -> dict[str, list[Matcher]]:
    """Matchers per language, and for :data:`ELSEWHERE`, by the scoping rule of the module."""
    own = {lang: [Matcher(terms, match)] for lang, terms in base.items()}
    elsewhere = [Matcher((t for terms in base.values() for t in terms), match)]
    for lang, terms in extra.items():
        own[lang] = [*own.get(lang, elsewhere), Matcher(terms, match)]
    own[ELSEWHERE] = elsewhere
    return own


def flag_expression(terms: Iterable[str], match: str) -> Callable[[Column], Column]:
    """Predicate over one cleaned token for a fixed set of terms."""
    exact = sorted(set(terms))
    if match == "exact":
        return lambda token: token.isin(exact)
    if match != "prefix":
        raise ValueError(f"unknown match mode: {match}")
    long_terms = [t for t in exact if len(t) >= MIN_PREFIX]
    starts = {t[:n] for t in long_terms for n in range(MIN_PREFIX, len(t) + 1)}
    whole = sorted(starts | set(exact))
    longest = max((len(t) for t in long_terms), default=0)
    by_length = {
        n: sorted({t for t in long_terms if len(t) == n}) for n in range(MIN_PREFIX, longest + 1)
    }

    def flagged(token: Column) -> Column:
        hit = token.isin(whole)
        for n, group in by_length.items():
            if group:
                hit = hit | F.substring(token, 1, n).isin(group)
        return hit

    return flagged


def by_language(
    lang: Column, terms: Terms, build: Callable[[list[str]], Column]
) -> Column:
    """``build(terms)`` of the row's language; unknown languages take the union of all terms."""
    groups: dict[tuple[str, ...], list[str]] = {}
    for code, group in terms.items():
        groups.setdefault(tuple(sorted(set(group))), []).append(code)
    union = tuple(sorted({t for group in groups for t in group}))
    choice = None
    for group, codes in groups.items():
        if group == union:
            continue
        condition = lang.isin(codes)
        value = build(list(group))
        choice = F.when(condition, value) if choice is None else choice.when(condition, value)
    fallback = build(list(union))
    return fallback if choice is None else choice.otherwise(fallback)


def _with_flat(df: DataFrame, text: str) -> DataFrame:
    return once(df, flat=tx.collapse(F.col(text)))


def delete_inline(
    df: DataFrame,
    terms: Terms,
    match: str = "prefix",
    text: str = "text",
    lang: str = "lang",
    out: str = "prediction",
    keep_marks: bool = False,
) -> DataFrame:
    """Drop matching tokens; a text that would become empty stays as it is.  A projection."""
    flat = F.col("flat")

    def kept(group: list[str]) -> Column:
        flagged = flag_expression(group, match)
        tokens = F.zip_with(
            tx.raw_tokens(flat),
            tx.clean_tokens(flat, keep_marks),
            lambda raw, clean: F.when(~flagged(clean), raw),
        )
        return F.array_join(tokens, " ")

    rewritten = once(_with_flat(df, text), **{out: by_language(F.col(lang), terms, kept)})
    return rewritten.withColumn(out, F.coalesce(F.nullif(F.col(out), F.lit("")), F.col(text))).drop("flat")


def count_flagged_inline(
    df: DataFrame,
    terms: Terms,
    match: str = "exact",
    text: str = "text",
    lang: str = "lang",
    keep_marks: bool = False,
) -> DataFrame:
    """Adds ``n_tokens`` and ``n_flagged``.  A projection."""
    flat = F.col("flat")

    def hits(group: list[str]) -> Column:
        return F.size(F.filter(tx.clean_tokens(flat, keep_marks), flag_expression(group, match)))

    return once(
        _with_flat(df, text),
        n_tokens=F.size(tx.raw_tokens(flat)) - (flat == "").cast("int"),
        n_flagged=by_language(F.col(lang), terms, hits),
    ).drop("flat")


# --- several lists in one pass ----------------------------------------------


@functools.cache
def _word_ranges(session: SparkSession, keep_marks: bool) -> tuple[tuple[int, int], ...]:
    """First and last of each run of code points that a cleaned token keeps, as the engine's own pattern tells."""
    pattern = tx.NON_WORD_OR_MARK_BUT_BLANK if keep_marks else tx.NON_WORD_BUT_BLANK
    every = "".join(chr(c) for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000)
    kept = session._jvm.java.util.regex.Pattern.compile(pattern).matcher(every).replaceAll("")
    codes = pd.Series(sorted(map(ord, kept)))
    runs = codes.groupby(codes - codes.index).agg(["min", "max"])
    return tuple(runs.itertuples(index=False, name=None))


class _Flags(dict):
    """What lower-case tokens of one scope match, a bit for every list; asks once per token."""

    def __init__(self, lists: list[list[Matcher]], kept: bytes) -> None:
        self.kept, self.dropped = kept, bytes(c for c in range(128) if not kept[c])
        self.whole: dict[str, int] = {}
        self.starts: dict[str, int] = {}
        for n, matcher in ((n, m) for n, own in enumerate(lists) for m in own):
            for found, tokens in ((self.whole, matcher.whole | matcher.starts), (self.starts, matcher.long_terms)):
                for token in tokens:
                    found[token] = found.get(token, 0) | 1 << n
        self.lengths = sorted({len(t) for t in self.starts})
        # long terms have these characters at least: most tokens are done here
        self.heads = {t[:MIN_PREFIX] for t in self.starts}

    def __missing__(self, token: str) -> int:
        if not token.isascii():
            clean = "".join([c for c in token if self.kept[ord(c)]])
        elif token.isalnum():
            clean = token
        else:
            clean = token.encode().translate(None, self.dropped).decode()
        found = self.whole.get(clean, 0)
        if clean[:MIN_PREFIX] in self.heads:
            for n in self.lengths:
                found |= self.starts.get(clean[:n], 0)
        if len(self) >= REMEMBERED:
            self.clear()
        self[token] = found
        return found


def flags_by_scope(df: DataFrame, lists: list[tuple[Terms, str]], keep_marks: bool = False) -> Callable[[], Callable]:
    """Maker, once per task, of a function from a language to the :class:`_Flags` of its lists, given with their match."""
    ranges = _word_ranges(df.sparkSession, keep_marks)
    lists = [({lang: list(group) for lang, group in terms.items()}, match) for terms, match in lists]

    def make() -> Callable[[str | None], _Flags]:
        kept = bytearray(sys.maxunicode + 1)
        for first, last in ranges:
            kept[first : last + 1] = b"\1" * (last + 1 - first)
        matchers = [scoped_matchers(terms, {}, match) for terms, match in lists]
        langs = {lang for own in matchers for lang in own}
        scopes = {lang: _Flags([own.get(lang, own[ELSEWHERE]) for own in matchers], bytes(kept)) for lang in langs}
        return lambda lang: scopes[lang if lang in scopes else ELSEWHERE]

    return make


def delete_each(
    df: DataFrame,
    rewrites: Mapping[str, tuple[Terms, str]],
    text: str = "text",
    lang: str = "lang",
    keep_marks: bool = False,
) -> DataFrame:
    """:func:`delete_inline` by several lists, each with its match, under the names of its columns; one pass over the texts."""
    make = flags_by_scope(df, list(rewrites.values()), keep_marks)
    names = list(rewrites)

    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        flags = make()
        for columns in batches:
            out: list[list] = [[] for _ in names]
            for whole, lower, scope in zip(*(c.tolist() for c in columns)):
                if whole is None:
                    for own in out:
                        own.append(None)
                    continue
                raw = whole.split()
                hits = list(map(flags(scope).__getitem__, lower.split()))
                flat, found = " ".join(raw), set(hits)
                for n, own in enumerate(out):
                    stays = {h: not h >> n & 1 for h in found}
                    own.append((flat if all(stays.values()) else " ".join(compress(raw, map(stays.__getitem__, hits)))) or whole)
            yield pd.DataFrame(dict(zip(names, out)), dtype=object)

    small_batches(df.sparkSession)
    udf = F.pandas_udf(run, ", ".join(f"`{name}` string" for name in names))
    keep = [F.col(f"`{c}`") for c in df.columns if c not in rewrites]
    found = df.select(*keep, udf(F.col(f"`{text}`"), F.lower(F.col(f"`{text}`")), F.col(f"`{lang}`")).alias("__each"))
    return found.select(*keep, *[F.col(f"__each.`{name}`").alias(name) for name in names])


# --- the same by joins ------------------------------------------------------


def distinct_tokens(df: DataFrame, id_col: str, text: str = "text", lang: str = "lang",
                    keep_marks: bool = False) -> DataFrame:
    """``id, lang, token``: the different cleaned tokens of each text; no language is ``""``."""
    known = F.coalesce(F.col(lang), F.lit("")).alias("lang")
    flat = _with_flat(df.select(F.col(id_col).alias("id"), known, text), text)
    return flat.select(
        "id", "lang", F.explode(F.array_distinct(tx.clean_tokens(F.col("flat"), keep_marks))).alias("token")
    ).filter(F.col("token") != "")


def vocabulary(tokens: DataFrame) -> DataFrame:
    """``lang, token, key_rows``: texts per token; frequent tokens combine before the shuffle."""
    return key_counts(tokens, ["lang", "token"])


def semi_join(tokens: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Tokens that are terms of their language."""
    return tokens.join(lexicon.select("lang", F.col("term").alias("token")), ["lang", "token"], "left_semi")


def anti_join(tokens: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Tokens that are no terms of their language."""
    return tokens.join(lexicon.select("lang", F.col("term").alias("token")), ["lang", "token"], "left_anti")


def scope_lexicon(lexicon: DataFrame, extra: DataFrame | None = None) -> DataFrame:
    """All terms by scope: those of each language, and the union of the base lists once, as :data:`ELSEWHERE`.

    The languages of the texts do not matter, nor how many have no list.
    """
    base = lexicon.select("lang", "term").distinct()
    scoped = base.unionByName(all_language_terms(base).select(F.lit(ELSEWHERE).alias("lang"), "term"))
    return scoped if extra is None else scoped.unionByName(extra.select("lang", "term")).distinct()


def scopes(lexicon: DataFrame, extra: DataFrame | None = None) -> DataFrame:
    """``lang, scopes`` of the languages that have terms: their own list, and the union if only extra ones are theirs."""
    langs = lexicon.select("lang", F.lit(1).alias("base"))
    if extra is not None:
        langs = langs.unionByName(extra.select("lang", F.lit(0).alias("base")))
    own = langs.groupBy("lang").agg(F.max("base").alias("base"))
    both = F.array(F.col("lang"), F.lit(ELSEWHERE))
    return own.select("lang", F.when(F.col("base") == 1, F.array("lang")).otherwise(both).alias("scopes"))


def flag_vocabulary(vocab: DataFrame, lexicon: DataFrame, match: str = "prefix") -> DataFrame:
    """Distinct tokens that match, by equi-joins only.

    ``starts with`` in both directions turns into equality by listing starts:
    those of the token against the long terms, and those of the long terms
    against the token.  Both lists are over distinct words, and the starts of a
    token stop at the longest term.
    """
    keys = ["lang", "token"]
    words = vocab.select(*keys)
    exact = semi_join(words, lexicon)
    if match == "exact":
        return exact
    if match != "prefix":
        raise ValueError(f"unknown match mode: {match}")
    long_terms = lexicon.filter(F.length("term") >= MIN_PREFIX).select("lang", "term").distinct()
    longest = long_terms.agg(F.coalesce(F.max(F.length("term")), F.lit(0))).scalar()
    long_words = words.filter(F.length("token") >= MIN_PREFIX)

    term_starts = (
        long_terms.withColumn("n", F.explode(F.sequence(F.lit(MIN_PREFIX), F.length("term"))))
        .select("lang", F.substring(F.col("term"), F.lit(1), F.col("n")).alias("token"))
        .distinct()
    )
    is_start_of_term = long_words.join(term_starts, keys, "left_semi")

    word_starts = (
        long_words.withColumn("upto", F.least(F.length("token"), longest))
        .filter(F.col("upto") >= MIN_PREFIX)
        .withColumn("n", F.explode(F.sequence(F.lit(MIN_PREFIX), F.col("upto"))))
        .select(*keys, F.substring(F.col("token"), F.lit(1), F.col("n")).alias("term"))
    )
    starts_with_term = word_starts.join(long_terms, ["lang", "term"], "left_semi").select(*keys)
    return exact.unionByName(is_start_of_term).unionByName(starts_with_term).distinct()


def flagged_tokens(df: DataFrame, lexicon: DataFrame, id_col: str, match: str, text: str, lang: str,
                   keep_marks: bool, extra: DataFrame | None = None) -> DataFrame:
    """``__id, __flagged``: the matching tokens of each text that has any.

    The vocabulary is written once: it is read for the match, for the longest
    term and for the frequencies, and each of these would tokenise the corpus again.
    """
    tokens = distinct_tokens(df, id_col, text, lang, keep_marks)
    vocab = materialize(vocabulary(tokens))
    scoped = materialize(scope_lexicon(lexicon, extra))
    keys = ["lang", "token"]
    here = vocab.join(sized(materialize(scopes(lexicon, extra))), "lang", "left").withColumn(
        "scope", F.explode(F.coalesce("scopes", F.array(F.lit(ELSEWHERE))))
    )
    words = here.select(F.col("scope").alias("lang"), "token").distinct()
    found = flag_vocabulary(words, scoped, match).withColumnRenamed("lang", "scope")
    matched = here.join(found, ["scope", "token"], "left_semi")
    flagged = materialize(matched.groupBy(*keys).agg(F.max("key_rows").alias("key_rows")))
    hits = flagged.select(*keys, F.lit(True).alias("hit"))
    # only flagged tokens find a partner, so their counts alone decide what is hot
    marked = lookup(tokens, hits, keys, ["hit"], flagged, ["id", "token"])
    return marked.filter("hit").groupBy(F.col("id").alias("__id")).agg(F.collect_set("token").alias("__flagged"))


# --- rewriting by sets in the tasks ------------------------------------------


def _rewritten(hit_of: Callable[[], Callable], counts: bool):
    """Vectorised function over (collapsed text, cleaned text, value): the kept tokens, or how many match.

    ``hit_of`` makes, once per task, a function from the value to a predicate over tokens.
    """

    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        predicate = hit_of()
        for flat, clean, given in batches:
            out: list = []
            for text, words, value in zip(flat, clean, given):
                if text is None or text != text:
                    out.append(None)
                    continue
                hit = predicate(value)
                if counts:
                    out.append(sum(map(hit, words.split(" "))))
                else:
                    pairs = zip(text.split(" "), words.split(" "))
                    out.append(" ".join([raw for raw, word in pairs if not hit(word)]))
            yield pd.Series(out, dtype=object)

    return F.pandas_udf(run, "int" if counts else "string")


def _by_scope(matchers: dict[str, list[Matcher]]) -> Callable[[], Callable]:
    def make() -> Callable:
        remembered: dict[str, dict[str, bool]] = {}

        def predicate(lang: str | None) -> Callable[[str], bool]:
            scope = lang if lang in matchers else ELSEWHERE
            own, known = matchers[scope], remembered.setdefault(scope, {})

            def hit(token: str) -> bool:
                found = known.get(token)
                if found is None:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    found = known[token] = any(m(token) for m in own)
                return found

            return hit

        return predicate

    return make


def _in_flagged() -> Callable:
    def predicate(flagged) -> Callable[[str], bool]:
        return frozenset().__contains__ if flagged is None else set(flagged).__contains__

    return predicate


def _with_hits(df: DataFrame, lexicon: DataFrame, id_col: str, match: str, text: str, lang: str, keep_marks: bool,
               extra: DataFrame | None) -> tuple[DataFrame, Callable, Column]:
    """``df`` and what a vectorised function needs to tell which tokens match: by sets, or beyond their size by joins."""
    small_batches(df.sparkSession)
    size = measured_bytes(lexicon.select("lang", "term"))
    size += measured_bytes(extra.select("lang", "term")) if extra is not None else 0
    if size <= LEXICON_BYTES:
        matchers = scoped_matchers(collect_terms(lexicon), collect_terms(extra) if extra is not None else {}, match)
        return df, _by_scope(matchers), F.col(f"`{lang}`")
    # ids may be null or repeat; equal id, language and text have equal hits (nulls are left out of the JSON)
    own = [F.col(f"`{c}`").alias(f"c{n}") for n, c in enumerate((id_col, lang, text))]
    df = df.withColumn("__key", F.md5(F.to_json(F.struct(*own)).cast("binary")))
    hits = flagged_tokens(df, lexicon, "__key", match, text, lang, keep_marks, extra)
    found = df.join(hits, F.col("__key") == F.col("__id"), "left")
    return found, _in_flagged, F.col("__flagged")


def delete_terms(
    df: DataFrame,
    lexicon: DataFrame,
    id_col: str,
    match: str = "prefix",
    text: str = "text",
    lang: str = "lang",
    out: str = "prediction",
    keep_marks: bool = False,
    extra: DataFrame | None = None,
) -> DataFrame:
    """The delete rewriter for a lexicon of any size; a text that would become empty stays as it is.

    ``extra`` terms count for their language on top of its base list or of the union.
    """
    columns = df.columns
    found, hit_of, last = _with_hits(df, lexicon, id_col, match, text, lang, keep_marks, extra)
    found = once(found, __flat=tx.collapse(F.col(f"`{text}`")))
    kept = _rewritten(hit_of, counts=False)(F.col("__flat"), tx.clean_text(F.col("__flat"), keep_marks), last)
    keep = [F.col(f"`{c}`") for c in columns if c != out]
    rewritten = found.select(*keep, kept.alias("__kept"))
    return rewritten.select(*keep, F.coalesce(F.nullif(F.col("__kept"), F.lit("")), F.col(f"`{text}`")).alias(out))


def count_flagged(
    df: DataFrame,
    lexicon: DataFrame,
    id_col: str,
    match: str = "exact",
    text: str = "text",
    lang: str = "lang",
    keep_marks: bool = False,
    extra: DataFrame | None = None,
) -> DataFrame:
    """As :func:`count_flagged_inline` for a lexicon of any size."""
    columns = df.columns
    found, hit_of, last = _with_hits(df, lexicon, id_col, match, text, lang, keep_marks, extra)
    found = once(found, __flat=tx.collapse(F.col(f"`{text}`")))
    flat = F.col("__flat")
    hits = _rewritten(hit_of, counts=True)(flat, tx.clean_text(flat, keep_marks), last)
    return found.select(
        *[F.col(f"`{c}`") for c in columns if c not in ("n_tokens", "n_flagged")],
        (F.size(tx.raw_tokens(flat)) - (flat == "").cast("int")).alias("n_tokens"),
        hits.alias("n_flagged"),
    )


# --- dispatch ---------------------------------------------------------------


def identity(df: DataFrame, text: str = "text", out: str = "prediction") -> DataFrame:
    """The do-nothing rewriter."""
    return df.withColumn(out, F.col(text))


def run_baseline(name: str, pairs: DataFrame, lexicon: DataFrame | None = None, id_col: str = "pair_id",
                 match: str = "prefix", extra: DataFrame | None = None) -> DataFrame:
    """Rewrite the toxic side of pairs by a named rewriter; ``delete`` needs a lexicon."""
    if name == "delete":
        return delete_terms(pairs, lexicon, id_col, match, text="toxic", extra=extra)
    if name == "identity":
        return identity(pairs, text="toxic")
    raise ValueError(f"Unknown baseline: {name}")
