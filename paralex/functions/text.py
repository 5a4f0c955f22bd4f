"""Text expressions: splitting, stripping and n-grams, all on the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as a text library sees it, for regular expressions of Java and RE2.
SPACE = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: Two or more word characters.
WORD = r"[\p{L}\p{N}_]{2,}"


def tokens_ws(text: Column) -> Column:
    """Pieces between runs of white space, none empty."""
    return F.filter(F.split(text, SPACE + "+"), lambda x: x != "")


def tokens_words(text: Column) -> Column:
    """Lower-cased words of two or more characters."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def without_space(text: Column) -> Column:
    return F.regexp_replace(text, SPACE, "")


def first_part(text: Column, delimiter: str) -> Column:
    return F.substring_index(text, delimiter, 1)


def last_part(text: Column, delimiter: str) -> Column:
    return F.substring_index(text, delimiter, -1)


def word_grams(tokens: Column, n: int) -> Column:
    """n-grams joined by a space; empty if there are fewer tokens."""
    count = F.size(tokens) - (n - 1)
    each = F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), lambda i: F.array_join(F.slice(tokens, i, n), " "))
    return F.when(count > 0, each).otherwise(F.array().cast("array<string>"))


def char_grams(text: Column, n: int) -> Column:
    """Substrings of n characters; empty if the text is shorter."""
    count = F.length(text) - (n - 1)
    each = F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), lambda i: F.substring(text, i, F.lit(n)))
    return F.when(count > 0, each).otherwise(F.array().cast("array<string>"))


def char_windows(text: Column, n: int) -> Column:
    """The substring of n characters from each place on; those at the end are shorter.

    Their prefixes of m characters are the text's m-grams.  The text is walked through once,
    while a substring by its place is counted from the start each time.
    """
    return F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{1,{n}}}))."), F.lit(1))


#: Replacements of the 13a tokenizer, in order.
_13A = (
    (r"<skipped>", ""),
    (r"-\n", ""),
    (r"\n", " "),
    (r"&quot;", '"'),
    (r"&amp;", "&"),
    (r"&lt;", "<"),
    (r"&gt;", ">"),
)
_13A_SPLITS = (
    (r"([\{-\~\[-\` -\&\(-\+\:-\@\/])", r" $1 "),
    (r"([^0-9])([\.,])", r"$1 $2 "),
    (r"([\.,])([^0-9])", r" $1 $2"),
    (r"([0-9])(-)", r"$1 $2 "),
)


def tokens_13a(text: Column) -> Column:
    """Tokens that BLEU counts."""
    for old, new in _13A:
        text = F.regexp_replace(text, old, new)
    text = F.concat(F.lit(" "), text, F.lit(" "))
    for old, new in _13A_SPLITS:
        text = F.regexp_replace(text, old, new)
    return tokens_ws(text)
