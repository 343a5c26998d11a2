"""String helpers shared by the text stages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from cuemill.functions.arrays import let

# The characters Unicode text is split on, and a letter, digit or underscore.
SPACE = (
    # the rare ones behind one range test, since most characters are none of them
    r"[\t-\r\x1c-\x20\x85\xa0"
    r"[\u1680-\u3000&&[\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]]]"
)
LETTER = r"[0-9A-Za-z_\p{L}\p{N}]"

# The same as a list of characters.
SPACES = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))

# Never part of a token, since text is split on it.
MARK = "\x1f"


def squeeze(text: Column) -> Column:
    """Every run of white space becomes one space, none at the ends."""
    return F.trim(F.regexp_replace(text, f"{SPACE}+", " "))


def trimmed(text: Column) -> Column:
    """Text without white space of any kind at its ends."""
    # a pattern would be tried at every character, not at the ends alone
    return F.btrim(text, F.lit(SPACES))


def tokens(text: Column) -> Column:
    none = F.array().cast("array<string>")
    return let(squeeze(text), lambda t: F.when(t == "", none).otherwise(F.split(t, " ")))


def token_count(text: Column) -> Column:
    """Number of words without building them."""

    def count(t):
        return F.when(t == "", 0).otherwise(F.length(t) - F.length(F.replace(t, F.lit(" "), F.lit(""))) + 1)

    return let(squeeze(text), count)


def strip(text: Column, chars: str) -> Column:
    return F.btrim(text, F.lit(chars))


def capital(text: Column) -> Column:
    """First character in upper case, the rest as it is."""
    return F.concat(F.upper(F.left(text, F.lit(1))), F.substring(text, 2, 2**31 - 1))


def ends_sentence(text: Column) -> Column:
    return F.right(text, F.lit(1)).isin(".", "!", "?")


def sentences(text: Column) -> Column:
    return F.split(text, rf"(?<=[.!?]){SPACE}+")


def whole_word(pattern: str) -> str:
    # the word itself first: it fails at once on most characters
    return rf"{pattern}(?<!{LETTER}{pattern})(?!{LETTER})"


def any_of(words: Sequence[str]) -> str:
    return "(?:" + "|".join(words) + ")"


def comparison_key(text: Column) -> Column:
    """Lower case, single spaces, no punctuation."""
    return F.regexp_replace(squeeze(F.lower(text)), rf"[^\p{{L}}\p{{N}}_ ]", "")
