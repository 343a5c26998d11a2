"""Hallucinated repetition: runs to collapse and cues to drop.

Both are single expressions over a text column, so they run in the scan's own
stage, whatever the size of a media item.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cuemill.functions.arrays import let
from cuemill.functions.text import MARK, token_count, tokens

# Punctuation cut from both ends of a word before words are compared.
RUN_PUNCTUATION = ".,!?;:¡¿"
CUE_PUNCTUATION = ".,!?;:¡¿…-"
LOOP_PUNCTUATION = ".,!?;:¡¿…"


def run_key(word: Column) -> Column:
    return F.btrim(F.lower(word), F.lit(RUN_PUNCTUATION))


def _run_pattern(word_limit: int, phrase_limit: int, longest: int) -> tuple[str, str]:
    """Pattern and replacement over "key MARK word " tokens, longest phrase first.

    The outer group of each alternative holds the copies to keep; the possessive
    tail takes all further copies without recursion, however long the run.
    """
    key, word = f"([^{MARK} ]+)", f"{MARK}[^ ]* "
    # a run can only start where the key comes back within the longest phrase
    returns = f"(?={key}{word}(?:[^ ]* ){{0,{longest - 1}}}?\\1{MARK})"
    alternatives, kept, group = [], [], 2
    for size in range(longest, 0, -1):
        # a run of one word is no phrase run
        uniform = ""
        keep = group
        group += 1
        if size > 1:
            uniform = f"(?!{key}{word}(?:\\{group}{word}){{{size - 1}}})"
            group += 1
        first = range(group, group + size)
        group += size
        again = "".join(f"\\{g}{word}" for g in first)
        limit = phrase_limit if size > 1 else word_limit
        copies = f"(?:{again}){{{limit - 1}}}"
        body = (key + word) * size
        # the look-ahead's group is numbered inside the kept group
        alternatives.append(f"({uniform}{body}{copies})(?:{again})++")
        kept.append(f"${keep}")
    return f"(?<![^ ]){returns}(?:{'|'.join(alternatives)})", "".join(kept)


def collapse_repetitions(text: Column, word_limit: int = 3, phrase_limit: int = 2) -> Column:
    """Keep the first copies of a repeated word or of a phrase of 2 to 5 words.

    Words are compared by key. The leftmost run is taken first, at one position
    the longest phrase; texts under four words are left alone.
    """
    pattern, kept = _run_pattern(word_limit, phrase_limit, longest=5)

    def collapse(words):
        shorter = F.regexp_replace(_coded(words), pattern, kept)
        return F.rtrim(F.regexp_replace(shorter, f"(?<![^ ])[^ {MARK}]*{MARK}", ""))

    return F.when(token_count(text) < 4, text).otherwise(let(tokens(text), collapse))


def _coded(words: Column) -> Column:
    return F.concat(
        F.array_join(F.transform(words, lambda w: F.concat(run_key(w), F.lit(MARK), w)), " "), F.lit(" ")
    )


def repetition_runs(text: Column, word_limit: int = 3, phrase_limit: int = 2) -> Column:
    """The runs that collapse_repetitions shortens: structs (from_word, phrase_words, copies, dropped_words), in order.

    Words count from 0; a null or short text has none.
    """
    pattern, kept = _run_pattern(word_limit, phrase_limit, longest=5)

    def size(coded):
        return F.length(coded) - F.length(F.replace(coded, F.lit(MARK), F.lit("")))

    def measured(run):
        def parts(rest):
            first = F.regexp_replace(rest, f"{MARK}[^ ]* ", " ")
            one_word = F.size(F.array_distinct(F.split(F.rtrim(first), " "))) == 1
            n, stays = size(run), size(rest)
            phrase = F.when(one_word, 1).otherwise(F.floor(stays / phrase_limit)).cast("int")
            return F.struct(n.alias("n"), phrase.alias("phrase"), (n - stays).alias("dropped"))

        return let(F.regexp_replace(run, pattern, kept), parts)

    def step(acc, x):
        at = acc["at"] + x["before"]
        run = F.struct(
            at.alias("from_word"),
            x["run"]["phrase"].alias("phrase_words"),
            F.floor(x["run"]["n"] / x["run"]["phrase"]).cast("int").alias("copies"),
            x["run"]["dropped"].alias("dropped_words"),
        )
        return F.struct((at + x["run"]["n"]).alias("at"), F.array_append(acc["runs"], run).alias("runs"))

    def found(coded):
        pairs = F.zip_with(
            F.transform(F.split(coded, pattern), size),
            F.transform(F.regexp_extract_all(coded, F.lit(pattern), 0), measured),
            lambda before, run: F.struct(before.alias("before"), run.alias("run")),
        )
        # one more text between runs than runs
        pairs = F.filter(pairs, lambda x: x["run"].isNotNull())
        return F.aggregate(pairs, F.struct(F.lit(0).alias("at"), none.alias("runs")), step, lambda acc: acc["runs"])

    none = F.array().cast("array<struct<from_word:int,phrase_words:int,copies:int,dropped_words:int>>")
    runs = let(tokens(text), lambda words: let(_coded(words), found))
    return F.when(token_count(text) >= 4, runs).otherwise(none)


def _top_two(words: Column) -> Column:
    """Occurrences of the two most frequent entries."""
    start = F.struct(
        F.lit(None).cast("string").alias("w"), F.lit(0).alias("run"), F.lit(0).alias("first"), F.lit(0).alias("second")
    )

    def closed(acc):
        first = F.greatest(acc["first"], acc["run"])
        second = F.greatest(acc["second"], F.least(acc["first"], acc["run"]))
        return first, second

    def step(acc, w):
        first, second = closed(acc)
        same = F.struct(
            w.alias("w"), (acc["run"] + 1).alias("run"), acc["first"].alias("first"), acc["second"].alias("second")
        )
        other = F.struct(w.alias("w"), F.lit(1).alias("run"), first.alias("first"), second.alias("second"))
        return F.when(acc["w"] == w, same).otherwise(other)

    def total(acc):
        first, second = closed(acc)
        return first + second

    return F.aggregate(F.sort_array(words), start, step, total)


def degenerate_rule(text: Column, duration_ms: Column | None = None) -> Column:
    """Name of the first rule that makes a cue noise, null for a normal cue."""

    def rule(words):
        keys = F.filter(F.transform(words, lambda w: F.btrim(F.lower(w), F.lit(CUE_PUNCTUATION))), lambda w: w != "")
        return let(keys, lambda k: by_keys(words, k))

    def by_keys(words, keys):
        n, distinct = F.size(keys), F.size(F.array_distinct(keys))
        wall = (n >= 8) & (distinct <= 2)
        # two words can only cover 90 % if the others are few
        two = (n >= 12) & (distinct <= n / 10 + 2) & (_top_two(keys) * 10 >= n * 9)

        def loop_length(w):
            core = F.btrim(w, F.lit(LOOP_PUNCTUATION))
            looped = (F.length(core) >= 12) & core.rlike(r"(?iu)^(.{1,3}?)\1{3,}.{0,3}$")
            return F.when(looped, F.length(w)).otherwise(0)

        def total(lengths):
            return F.aggregate(lengths, F.lit(0), lambda a, x: a + x)

        loop = total(F.transform(words, loop_length)) * 2 >= total(F.transform(words, F.length))

        letters = F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]", "")

        def letter_share(chars):
            # a character on 60 % of the places is the middle one in sorted order
            size = F.length(chars)
            middle = F.element_at(F.sort_array(F.split(chars, "")), F.floor(size / 2).cast("int") + 1)
            count = size - F.length(F.replace(chars, middle, F.lit("")))
            return (size >= 15) & (count * 5 >= size * 3)

        named = (
            F.when(n < 0, None)
            .when(wall, "repetition wall")
            .when(two, "two words")
            .when(loop, "character loop")
            .when(let(letters, letter_share), "one character")
        )
        if duration_ms is None:
            return named
        dense = (duration_ms > 0) & (F.length(text) * 20 > duration_ms) & (n >= 8)
        return named.when(dense, "density")

    return F.when(token_count(text) > 0, let(tokens(text), rule))


def is_degenerate(text: Column, duration_ms: Column | None = None) -> Column:
    return F.coalesce(degenerate_rule(text, duration_ms).isNotNull(), F.lit(False))
