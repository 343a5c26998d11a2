"""Transcript text stages. Each is an expression over one text column.

Greedy cutting rules (sentences, paragraphs) are written as one pattern whose
match is exactly one piece, so a text is cut in a single pass however long it is.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cuemill.functions import lexicon
from cuemill.functions.arrays import indexes, let
from cuemill.functions.repetition import collapse_repetitions
from cuemill.functions.text import (
    LETTER,
    MARK,
    SPACE,
    any_of,
    capital,
    ends_sentence,
    sentences,
    squeeze,
    strip,
    token_count,
    tokens,
    whole_word,
)

EDGE = ".,!?"


def is_english(language: Column) -> Column:
    return F.lower(F.coalesce(language, F.lit("en"))).startswith("en")


# --- all languages -----------------------------------------------------------


def pack_sentences(text: Column, max_chars: int = 10_000) -> Column:
    """Pieces of whole sentences holding at most max_chars, spaces not counted."""

    def pack(items):
        start = F.struct(F.lit(0).alias("size"), F.array(F.lit(0)).alias("cuts"))

        def step(acc, i):
            size = F.length(F.get(items, i))
            full = (acc["size"] + size > max_chars) & (i > F.element_at(acc["cuts"], -1))
            opened = F.struct(size.alias("size"), F.concat(acc["cuts"], F.array(i)).alias("cuts"))
            grown = F.struct((acc["size"] + size).alias("size"), acc["cuts"].alias("cuts"))
            return F.when(full, opened).otherwise(grown)

        cuts = F.aggregate(indexes(F.size(items)), start, step, lambda acc: acc["cuts"])
        return let(cuts, lambda c: F.transform(c, lambda at, k: piece(items, at, F.get(c, k + 1))))

    def piece(items, at, following):
        upto = F.coalesce(following, F.size(items))
        return F.array_join(F.slice(items, at + 1, upto - at), " ")

    short = F.length(text) <= max_chars
    whole = F.transform(F.array(text), lambda t: F.array_join(sentences(t), " "))
    return F.when(short, whole).otherwise(let(sentences(text), pack))


def well_formed(sentence: Column) -> Column:
    return (
        sentence.rlike(r"^\p{Lu}")
        & ends_sentence(sentence)
        & ~sentence.rlike(f"{SPACE}{{2,}}")
        & (token_count(sentence) > 1)
    )


def formatting_break(text: Column) -> Column:
    """struct(formatted, unformatted): the text before and from the first badly formed sentence."""

    def split(items):
        # the first bad sentence keeps its index; -1 when there is none
        bad = F.array_position(
            F.transform(items, lambda s: ~well_formed(s) & (F.trim(squeeze(s)) != "")), F.lit(True)
        ).cast("int")
        return F.struct(
            F.when(bad == 0, text).otherwise(F.array_join(F.slice(items, F.lit(1), bad - 1), " ")).alias("formatted"),
            F.when(bad == 0, "").otherwise(
                F.array_join(F.slice(items, F.greatest(bad, F.lit(1)), F.size(items)), " ")
            ).alias("unformatted"),
        )

    return let(sentences(text), split)


def format_sentence(sentence: Column, english: Column) -> Column:
    """Single spaces, capital start, I, and an end mark."""

    def finish(s):
        first = F.lower(F.substring_index(s, " ", 1))
        mood = F.lower(s).rlike(any_of(lexicon.MOOD_WORDS))
        mark = (
            F.when(~english, ".").when(first.isin(*lexicon.QUESTION_STARTERS), "?").when(mood, "!").otherwise(".")
        )
        return F.when(ends_sentence(s), s).otherwise(F.concat(s, mark))

    start = capital(squeeze(sentence))
    return let(F.when(english, F.regexp_replace(start, whole_word("i"), "I")).otherwise(start), finish)


def format_text(text: Column, english: Column) -> Column:
    def formatted(t):
        pieces = F.filter(F.split(t, rf"(?<=[.!?]){SPACE}+(?=[A-Z])"), lambda s: F.length(squeeze(s)) >= 2)
        long = F.array_join(F.transform(pieces, lambda s: format_sentence(s, english)), " ")
        short = F.when(ends_sentence(t) | (t == ""), capital(t)).otherwise(F.concat(capital(t), F.lit(".")))
        return F.when(F.length(t) < 10, short).otherwise(long)

    return let(squeeze(text), formatted)


def format_transcript(text: Column, language: Column) -> Column:
    """Collapse repetition, repair what is badly formatted piece by piece, format the whole."""
    english = is_english(language)

    def repaired(piece):
        def join(parts):
            fixed = F.concat(parts["formatted"], F.lit(" "), format_text(parts["unformatted"], english))
            return F.when(parts["unformatted"] == "", parts["formatted"]).otherwise(fixed)

        return let(formatting_break(piece), join)

    return let(
        collapse_repetitions(text),
        lambda t: format_text(F.array_join(F.transform(pack_sentences(t), repaired), " "), english),
    )


# --- English only --------------------------------------------------------------


def basic_clean(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(squeeze(text), r"\[.*?\]", ""), r"\(.*?\)", "")


def _filler_pattern() -> str:
    """Phrases of up to four words, the longest first, with outer punctuation."""
    phrases = sorted(lexicon.FILLERS, key=lambda p: (-len(p.split()), p))
    return rf"(?iu)(?<![^ ])[{EDGE}]*({'|'.join(phrases)})[{EDGE}]*(?![^ ])"


def remove_fillers(text: Column) -> Column:
    return squeeze(F.regexp_replace(squeeze(text), _filler_pattern(), ""))


def fillers_in(text: Column) -> Column:
    """The removed phrases, in lower case and order of use."""
    found = F.regexp_extract_all(squeeze(text), F.lit(_filler_pattern()), F.lit(1))
    return F.transform(found, F.lower)


def drop_doubled_words(text: Column) -> Column:
    return F.regexp_replace(text, rf"(?iu)(?<!{LETTER})({LETTER}++){SPACE}+\1(?!{LETTER})", "$1")


def expand_contractions(text: Column) -> Column:
    def expand(t):
        out = t
        for spoken, written in lexicon.CONTRACTIONS.items():
            out = F.regexp_replace(out, "(?iu)" + whole_word(spoken), written)
        return F.when(t.rlike("(?iu)" + any_of(list(lexicon.CONTRACTIONS))), out).otherwise(t)

    return let(text, expand)


def break_sentences(text: Column) -> Column:
    """End a sentence before a contrast word after 9 words, a pronoun after 16, or at 26 words."""
    contrast = any_of(lexicon.CONTRAST_WORDS)
    either = any_of(lexicon.CONTRAST_WORDS + lexicon.PRONOUNS)
    more = r"(?: [^ ]+)"
    pattern = (
        rf"(?iu)(?<![^ ])([^ ]+{more}{{8,14}}?(?= {contrast}(?![^ ]))"
        rf"|[^ ]+{more}{{15,24}}?(?= {either}(?![^ ]))"
        rf"|[^ ]+{more}{{25}})"
    )

    def closed(sentence, k, count):
        question = F.lower(F.substring_index(sentence, " ", 1)).isin(*lexicon.QUESTION_STARTERS, "had")
        # the words left over at the end are never a question
        mark = F.when(question & (k < count - 1), "?").otherwise(".")
        return F.when(ends_sentence(sentence), sentence).otherwise(F.concat(sentence, mark))

    def close_all(items):
        # a cut at the very end leaves an empty piece, which stands for "nothing left over"
        real = F.when(F.element_at(items, -1) == "", F.slice(items, 1, F.size(items) - 1)).otherwise(items)
        return F.array_join(F.transform(real, lambda s, k: closed(s, k, F.size(items))), " ")

    def cut(t):
        pieces = F.split(F.regexp_replace(t, pattern, "$1" + MARK), MARK + " ?")
        return F.when(t == "", "").otherwise(let(pieces, close_all))

    return let(squeeze(text), cut)


def add_commas(text: Column) -> Column:
    text = F.regexp_replace(text, f"{SPACE}+({'|'.join(lexicon.CONJUNCTIONS)}){SPACE}+", ", $1 ")
    text = F.regexp_replace(text, f"^({'|'.join(lexicon.OPENERS)})", "$1,")
    text = F.regexp_replace(text, f",{SPACE}*,", ",")
    return F.regexp_replace(text, r",\.", ".")


def lexicon_case(word: Column) -> Column:
    """Proper nouns with a capital, abbreviations in upper case, one end mark kept."""
    key = strip(F.lower(word), EDGE)
    last = F.right(word, F.lit(1))
    marked = last.isin(*EDGE)
    core = F.when(marked, F.left(word, F.length(word) - 1)).otherwise(word)
    mark = F.when(marked, last).otherwise("")
    noun = F.concat(capital(F.lower(core)), mark)
    listed = F.when(key.isin(*lexicon.PROPER_NOUNS), noun).otherwise(F.concat(F.upper(core), mark))
    return F.when(key.isin(*lexicon.PROPER_NOUNS, *lexicon.ABBREVIATIONS), listed).otherwise(word)


def fix_case(text: Column) -> Column:
    def sentence(s):
        start = F.regexp_replace(capital(s), whole_word("i"), "I")
        return F.array_join(F.transform(tokens(start), lexicon_case), " ")

    kept = F.filter(sentences(text), lambda s: squeeze(s) != "")
    return F.array_join(F.transform(kept, sentence), " ")


def paragraphs(text: Column) -> Column:
    """Groups of 3 to 5 sentences; fewer than 5 only before a transition word."""
    one = f"[^{MARK}]*"
    more = f"(?:{MARK}{one})"
    pattern = (
        # only tried where a sentence starts, or a long tail would be scanned from every character
        f"(?<![^{MARK}])({one}{more}{{2,3}}?(?={MARK}{any_of(lexicon.TRANSITIONS)})|{one}{more}{{4}}(?={MARK})){MARK}"
    )
    joined = F.array_join(sentences(text), MARK)
    cut = F.split(F.regexp_replace(joined, pattern, "$1" + MARK + MARK), MARK * 2)
    return F.transform(cut, lambda p: F.replace(p, F.lit(MARK), F.lit(" ")))


def polish(text: Column) -> Column:
    text = F.regexp_replace(text, rf"{SPACE}+([{EDGE}])", "$1")
    text = F.regexp_replace(text, rf"([{EDGE}])([A-Z])", "$1 $2")
    text = F.regexp_replace(text, rf"([{EDGE}]){SPACE}+", "$1 ")
    text = F.regexp_replace(text, f'"{SPACE}+', '"')
    text = F.regexp_replace(text, f'{SPACE}+"', '"')
    return squeeze(text)


def clean_english(text: Column, keep_fillers: bool = False) -> Column:
    text = basic_clean(text)
    if not keep_fillers:
        text = remove_fillers(text)
    text = expand_contractions(drop_doubled_words(text))
    return fix_case(add_commas(break_sentences(text)))
