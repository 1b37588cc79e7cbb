"""Text expressions: tokens, n-grams, prompts, snippets and digests, all as columns."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: A run of letters, digits and underscores of any script, as a Unicode word pattern finds it.
TOKEN = r"[\p{L}\p{N}_]+"


def tokens(text: Column) -> Column:
    """Lower-case word tokens in order; a null text has none."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))


def word_ngrams(words: Column, n: int) -> Column:
    """Runs of n tokens joined by one space."""
    grams = F.transform(F.sequence(F.lit(1), F.size(words) - n + 1), lambda i: F.array_join(F.slice(words, i, F.lit(n)), " "))
    return F.when(F.size(words) >= n, grams).otherwise(F.array().cast("array<string>"))


def prompt(template: str, text: Column, instruction: Column | None = None) -> Column:
    """Fill ``{text}`` and ``{instruction}``; text alone where the template wants an instruction and none is given.

    The template is cut once on the driver, so braces inside texts stay as they are.
    """
    if "{text}" not in template:
        raise ValueError("a template needs {text}")
    parts: list[Column] = []
    for piece in template.replace("{text}", "\0t\0").replace("{instruction}", "\0i\0").split("\0"):
        parts.append(text if piece == "t" else instruction if piece == "i" and instruction is not None else F.lit("" if piece == "i" else piece))
    filled = F.concat(*parts)
    if "{instruction}" not in template:
        return filled
    return text if instruction is None else F.when(instruction.isNull(), text).otherwise(filled)


def strip(text: Column) -> Column:
    """Without Unicode white space at the ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def snippet(text: Column, size: int = 160) -> Column:
    return F.substring(F.replace(text, F.lit("\n"), F.lit(" ")), 1, size)


def title_and_text(title: Column, text: Column, joint: str = "\n") -> Column:
    return F.when(F.trim(F.coalesce(title, F.lit(""))) != "", F.concat_ws(joint, title, text)).otherwise(text)


def usage(text: Column) -> Column:
    """Rough number of model tokens of a text."""
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4)).cast("long")


def _folded(texts: pd.Series) -> pd.Series:
    return pd.Series([None if x is None else unicodedata.normalize("NFKC", x).casefold() for x in texts], dtype=object)


def folded(text: Column) -> Column:
    """NFKC and case folding. Plain ASCII stays with the engine's own lower case; only other texts go to Python."""
    other = text.rlike(r"[^\x00-\x7F]")
    return F.when(other, F.pandas_udf(_folded, "string")(F.when(other, text))).otherwise(F.lower(text))


def token_digest(text: Column) -> Column:
    """Digest of the sorted multiset of folded tokens: texts that differ in order, case, width or punctuation agree."""
    words = F.regexp_extract_all(F.coalesce(folded(text), F.lit("")), F.lit(TOKEN), F.lit(0))
    return F.sha2(F.array_join(F.sort_array(words), " "), 256)
