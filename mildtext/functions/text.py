"""Text expressions with the white-space and word rules of Python strings.

All of them are built-in JVM expressions.  White space is the Unicode set that
``str.split`` uses (not only U+0020), and a word character is a letter, a
decimal or other number, or the underscore.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Character classes, the same in Java and RE2 syntax.
SPACE = r"[\t-\r\x1c-\x20\x85\p{Z}]"
# The same one by one.
SPACES = "".join(map(chr, [*range(0x9, 0xE), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
                           0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
# Java syntax only.
SPACE_BUT_BLANK = r"[\t-\r\x1c-\x1f\x85\p{Z}&&[^ ]]"
NON_WORD = r"[^\p{L}\p{N}_]"
NON_WORD_BUT_BLANK = r"[^\p{L}\p{N}_ ]"
NON_WORD_OR_MARK_BUT_BLANK = r"[^\p{L}\p{M}\p{N}_ ]"


def strip(c: Column) -> Column:
    """Remove leading and trailing white space; only the ends are read."""
    return F.trim(c, F.lit(SPACES))


def collapse(c: Column) -> Column:
    """Every run of white space becomes one blank; none at the ends.  Single blanks are not touched."""
    return F.trim(F.regexp_replace(c, f"{SPACE_BUT_BLANK}{SPACE}*|{SPACE}{{2,}}", " "))


def words(c: Column) -> Column:
    """White-space separated words; an empty array for blank text."""
    return F.array_remove(F.split(c, f"{SPACE}+"), "")


def first_words(c: Column, n: int) -> Column:
    """The first ``n`` words; the rest of the text is not cut up."""
    return F.slice(F.array_remove(F.split(c, f"{SPACE}+", n + 2), ""), 1, n)


def word_count(c: Column) -> Column:
    return F.size(words(c))


def first_filled(*cols: Column) -> Column:
    """First value that is neither null nor empty, else an empty string."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cols], F.lit(""))


def raw_tokens(flat: Column) -> Column:
    """Tokens of already collapsed text."""
    return F.split(flat, " ", -1)


def clean_text(flat: Column, keep_marks: bool = False) -> Column:
    """Collapsed text in lower case without non-word characters, blanks as they are.

    Combining marks are dropped by default; ``keep_marks`` keeps them, which scripts with
    vowel signs need.
    """
    pattern = NON_WORD_OR_MARK_BUT_BLANK if keep_marks else NON_WORD_BUT_BLANK
    return F.regexp_replace(F.lower(flat), pattern, "")


def clean_tokens(flat: Column, keep_marks: bool = False) -> Column:
    """Cleaned tokens of collapsed text.

    The whole text is cleaned by one pass of the pattern and then cut at the
    blanks, so element i belongs to element i of :func:`raw_tokens`; a token of
    punctuation only becomes an empty string.
    """
    return F.split(clean_text(flat, keep_marks), " ", -1)


def pair_hash(toxic: Column, neutral: Column) -> Column:
    """Case-sensitive identity of a pair."""
    return F.md5(F.concat(toxic, F.lit("|||"), neutral))


def seeded_hash(seed: int, *ids: Column) -> Column:
    """Pseudo-random, partition-independent order of rows: hex digest of seed and ids."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[i.cast("string") for i in ids]))


def normalize_lang(c: Column) -> Column:
    """First two letters, lower case, of a language label."""
    return F.substring(F.lower(strip(c)), 1, 2)


# What the mteval-v13a tokenizer replaces first, in order.
UNESCAPED_13A = (
    ("<skipped>", ""),
    ("-\n", ""),
    ("\n", " "),
    ("&quot;", '"'),
    ("&amp;", "&"),
    ("&lt;", "<"),
    ("&gt;", ">"),
)


def unescape_and_pad_13a(c: Column) -> Column:
    """First half of the mteval-v13a tokenizer: join hyphenated breaks, unescape, pad."""
    t = F.regexp_replace(c, f"{SPACE}+$", "")
    for old, new in UNESCAPED_13A:
        t = F.replace(t, F.lit(old), F.lit(new))
    return F.concat(F.lit(" "), t, F.lit(" "))


# The mteval-v13a punctuation rules, in order, Java replacement syntax.  The first one's
# blank is left out: a run of blanks is no other than one to the rules after it, and is collapsed in the end.
RULES_13A = (
    (r"([{-~\[-`!-&(-+:-@/])", " $1 "),
    (r"([^0-9])([.,])", "$1 $2 "),
    (r"([.,])([^0-9])", " $1 $2"),
    (r"([0-9])(-)", "$1 $2 "),
)


def flat_13a(c: Column) -> Column:
    """Text after mteval-v13a tokenisation, words separated by one blank, as corpus BLEU wants it."""
    t = unescape_and_pad_13a(c)
    for pattern, replacement in RULES_13A:
        t = F.regexp_replace(t, pattern, replacement)
    return collapse(t)


def without_space(c: Column) -> Column:
    """Text without white space, as chrF wants it."""
    return F.regexp_replace(c, f"{SPACE}+", "")
