"""Text columns: tokens, stop words, n-grams and per-document term counts.

All of it is built-in array functions inside one row, so a document is never spread over a shuffle to be counted.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

# Fixed value: a token is a run of two or more letters, digits or underscores of any script.
WORD_CHARACTER = r"[\p{L}\p{N}_]"
TOKEN_PATTERN = WORD_CHARACTER + "{2,}"


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN_PATTERN), F.lit(0))


def drop_stop_words(words: Column, stop_words: Sequence[str]) -> Column:
    # Apostrophes split tokens, so a listed word that holds one can never match.
    listed = [w for w in stop_words if "'" not in w]
    return F.filter(words, lambda w: ~w.isin(listed))


def bigrams(words: Column) -> Column:
    """Each pair of neighbours joined by a space; a pair with a null word is null."""
    length = F.greatest(F.size(words) - 1, F.lit(0))
    return F.zip_with(
        F.slice(words, F.lit(1), length),
        F.slice(words, F.lit(2), length),
        lambda a, b: F.concat(a, F.lit(" "), b),
    )


def unigrams_and_bigrams(words: Column) -> Column:
    return F.concat(words, bigrams(words))
