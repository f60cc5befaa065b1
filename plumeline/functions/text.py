"""Text expressions, Column to Column."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

#: What Python's str.strip takes away from the texts at hand.
SPACE = " \t\n\r"
#: A word with inner apostrophes and hyphens.
WORD = r"[\p{L}\p{N}_]+(?:['-][\p{L}\p{N}_]+)*"

def strip(c: Column) -> Column:
    return F.trim(c, F.lit(SPACE))


def words(c: Column) -> Column:
    """Lower-case words of a text."""
    return F.regexp_extract_all(F.lower(c), F.lit(WORD), F.lit(0))


def sentences(c: Column) -> Column:
    """Stripped sentences: split after . ! or ? and white space; empty ones go."""
    return F.filter(F.transform(F.split(c, r"(?<=[.!?])\s+"), strip), lambda s: s != "")


@F.pandas_udf(StringType())
def _unescaped_once(texts: pd.Series) -> pd.Series:
    return texts.map(html.unescape, na_action="ignore")


@F.pandas_udf(StringType())
def _unescaped(texts: pd.Series) -> pd.Series:
    def whole(text: str) -> str:
        while (plain := html.unescape(text)) != text:
            text = plain
        return text

    return texts.map(whole, na_action="ignore")


def unescape(c: Column, once: bool = False) -> Column:
    """All character references of HTML 5, named and numeric, replaced: over and over (`&amp;quot;`), or in one pass.

    The table of names and the rules for references without a semicolon are the standard library's; only texts with an
    ampersand are sent to it.
    """
    marked = F.when(F.contains(c, F.lit("&")), c)
    return F.coalesce((_unescaped_once if once else _unescaped)(marked), c)


@F.pandas_udf(ArrayType(StringType()))
def _unescaped_each(lists: pd.Series) -> pd.Series:
    return lists.map(lambda texts: [t if t is None else html.unescape(t) for t in texts], na_action="ignore")


def unescape_each(c: Column) -> Column:
    """One pass over every text of a list."""
    marked = F.when(F.exists(c, lambda t: F.contains(t, F.lit("&"))), c)
    return F.coalesce(_unescaped_each(marked), c)


def clean_html(c: Column) -> Column:
    """References and tags out, runs of spaces to one."""
    c = F.regexp_replace(unescape(c), r"<br\s*/?>", " ")
    c = F.regexp_replace(c, r"</?[a-zA-Z][^>]*>", " ")
    return strip(F.regexp_replace(c, r" {2,}", " "))


def hash_bucket(text: Column, mod: int, salt: str = "") -> Column:
    """The SHA-1 digest of salt and text, taken as a number, modulo 2, 5 or 10.

    Every power of 16 ends in 6, so a hexadecimal number modulo 10 is its last digit plus six times the others.
    """
    if mod not in (2, 5, 10):
        raise ValueError("only moduli that divide 10")
    digest = F.sha1(F.encode(F.concat(F.lit(salt + "|"), F.lower(strip(text))), "UTF-8"))
    digits = F.transform(F.split(digest, ""), lambda d: F.conv(d, 16, 10).cast("int"))
    total = F.aggregate(digits, F.lit(0), lambda a, d: a + d)
    last = F.conv(F.right(digest, F.lit(1)), 16, 10).cast("int")
    return ((last + 6 * (total - last)) % 10 % mod).cast("int")


def split_name(text: Column) -> Column:
    """`profile` for eight tenths of the keys, `val` for the rest."""
    return F.when(hash_bucket(text, 10, "split") < 8, "profile").otherwise("val")


def strip_edges(c: Column) -> Column:
    """Punctuation at a word's ends, apostrophes excepted, taken away."""
    return F.regexp_replace(c, r"^[^a-zA-Z0-9']+|[^a-zA-Z0-9']+$", "")


def split_camel(c: Column) -> Column:
    """Underscores and capitals inside a value taken as word borders."""
    c = F.replace(strip(c), F.lit("_"), F.lit(" "))
    c = F.regexp_replace(c, "([a-z])([A-Z])", "$1 $2")
    return strip(F.regexp_replace(c, "([A-Z]+)([A-Z][a-z])", "$1 $2"))
