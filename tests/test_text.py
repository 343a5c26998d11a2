"""Text stages against short loops that state the rules."""

import random
import re
from bisect import bisect_right
from collections import Counter
from itertools import accumulate, pairwise

import pytest
from pyspark.sql import functions as F

from cuemill.functions import cleaning, lexicon
from cuemill.functions.layout import balanced_lines, middle_lines, pack_captions
from cuemill.functions.repetition import collapse_repetitions, degenerate_rule, repetition_runs
from cuemill.plans.transcript import clean_transcripts

VOCABULARY = (
    "but however he she and so i monday ai, um you know mean like i said what is the quick. brown Fox. jumps! However, "
    'Then over gonna cause lazy [x y] (z) dog. zzz... "hi" the the know what i mean um, eu. usa! First a b c d e'
).split(" ")


@pytest.fixture(scope="module")
def texts():
    random.seed(5)
    some = ["", "  ", "ok", "i", "what is this now really"]
    for _ in range(1500):
        n = random.randint(0, 90)
        some.append(random.choice(["", " "]) + random.choice([" ", "  "]).join(random.choices(VOCABULARY, k=n)))
    return some


def results(spark, texts, column):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", column.alias("r"))
    return [r.r for r in sorted(df.collect(), key=lambda r: r.i)]


def keys(words, marks=".,!?;:¡¿"):
    return [w.lower().strip(marks) for w in words]


def collapsed(text):
    """By patterns: a phrase of one to five words and its repeats, the longest kind first at every word."""
    words = text.split()
    if len(words) < 4:
        return text
    # words that are punctuation only never repeat
    line = "".join((k or f"\0{i}") + " " for i, k in enumerate(keys(words)))
    kinds = [(5, 2), (4, 2), (3, 2), (2, 2), (1, 3)]
    out, at = [], 0
    while at < len(line):
        first = line.count(" ", 0, at)
        for p, kept in kinds:
            m = re.compile(rf"((?:\S+ ){{{p}}})\1{{{kept},}}").match(line, at)
            if m and (p == 1 or len(set(m[1].split())) > 1) and "\0" not in m[1]:
                out += words[first : first + p * kept]
                at = m.end()
                break
        else:
            out.append(words[first])
            at = line.index(" ", at) + 1
    return " ".join(out)


def test_collapse(spark):
    random.seed(3)
    some = ["go go go go go go home now", "left, right, up, left, right, up, left, right, up, left, right, up, stop", "a " * 100_000]
    pool = ["a", "A,", "b.", "c", "...", "ñ!", "aa"]
    for _ in range(4000):
        some.append(random.choice([" ", "  "]).join(random.choices(pool[: random.randint(1, 7)], k=random.randint(0, 24))))
    got = results(spark, some, collapse_repetitions(F.col("t")))
    assert got[0] == "go go go home now"
    assert got[1] == "left, right, up, left, right, up, stop"
    assert got == [collapsed(t) for t in some]
    # every run is where it is said to be, and the rest of the text without it is what stays
    for t, shorter, runs in zip(some, got, results(spark, some, repetition_runs(F.col("t")))):
        words, gone = t.split(), set()
        compared = keys(words)
        for r in runs:
            copies = [compared[r.from_word + k * r.phrase_words :][: r.phrase_words] for k in range(r.copies)]
            assert all(c == copies[0] for c in copies) and len(copies[0]) == r.phrase_words
            end = r.from_word + r.copies * r.phrase_words
            gone |= set(range(end - r.dropped_words, end))
            assert r.copies * r.phrase_words - r.dropped_words == r.phrase_words * (2 if r.phrase_words > 1 else 3)
        assert [w for k, w in enumerate(words) if k not in gone] == shorter.split()


def test_degenerate_cues(spark):
    many = " ".join(f"term{i}" for i in range(24))
    cases = [
        (", ".join(["hey"] * 30) + "!", None, True),
        (", ".join(["hold it"] * 25) + "?", None, True),
        ("A" + "-a" * 90, None, True),
        ("Eeeeeeeeeeeeeeeeeeeeeeeee.", None, True),
        (many, 1000, True),
        (many, 9000, False),
        ("Yes, yes, yes.", None, False),
        ("Easy, easy, take it slow.", None, False),
        ("The second half of the talk is about rivers.", 3000, False),
        ("up down " * 9 + "or left", None, True),
    ]
    df = spark.createDataFrame([(i, t, d) for i, (t, d, _) in enumerate(cases)], "i int, t string, d int")
    got = df.select("i", degenerate_rule(F.col("t"), F.col("d")).alias("r")).collect()
    assert [r.r is not None for r in sorted(got, key=lambda r: r.i)] == [c[2] for c in cases]


def sentence_ends(words):
    """How many words each sentence takes, from where contrast words and pronouns stand."""
    low = [w.lower() for w in words]
    contrast = [i for i, w in enumerate(low) if w in lexicon.CONTRAST_WORDS]
    pronoun = [i for i, w in enumerate(low) if w in lexicon.PRONOUNS]
    at = 0
    while at < len(words):
        ends = [i for i in contrast if i - at >= 9] + [i for i in pronoun if i - at >= 16] + [at + 26]
        cut = min(ends)
        yield at, min(cut, len(words)), cut <= len(words) and (cut < len(words) or cut == at + 26)
        at = cut


def test_break_sentences(spark, texts):
    def expected(text):
        words, out = text.split(), []
        for a, b, complete in sentence_ends(words):
            s = " ".join(words[a:b])
            asks = complete and words[a].lower() in [*lexicon.QUESTION_STARTERS, "had"]
            out.append(s if s[-1] in ".!?" else s + ("?" if asks else "."))
        return " ".join(out)

    more = [*texts, "hello there .", ".", "we said ,", "what is it ?", ("word " * 26).strip(), ("what " * 26).strip() + " ."]
    assert results(spark, more, cleaning.break_sentences(F.col("t"))) == [expected(t) for t in more]
    assert results(spark, ["Hello to all my friends [noise]."], cleaning.polish(cleaning.clean_english(F.col("t"))))[0].endswith("friends.")


def test_remove_fillers(spark, texts):
    fillers = set(lexicon.FILLERS)

    def expected(text):
        words = text.split()
        spans = [
            (i, -n)
            for i in range(len(words))
            for n in range(1, 5)
            if i + n <= len(words) and " ".join(words[i : i + n]).lower().strip(".,!?") in fillers
        ]
        covered, end = set(), 0
        # from the left, the longest first, none inside another
        for i, n in sorted(spans):
            if i >= end:
                end = i - n
                covered.update(range(i, end))
        return " ".join(w for i, w in enumerate(words) if i not in covered)

    # longer slices than are left repeat the shorter ones, which is the same phrase
    assert results(spark, texts, cleaning.remove_fillers(F.col("t"))) == [expected(t) for t in texts]


def sentence_split(text):
    return re.split(r"(?<=[.!?])\s+", text)


def test_paragraphs(spark, texts):
    """An end is admissible 3 or 4 sentences on before a transition, 5 on anyway; the smallest is taken."""

    def expected(text):
        parts = sentence_split(text)
        turns = {i for i, s in enumerate(parts) if s.startswith(tuple(lexicon.TRANSITIONS))}
        ends = [0]
        while ends[-1] < len(parts):
            at = ends[-1]
            ends.append(min([at + 5, len(parts), *(turns & {at + 3, at + 4})]))
        return [" ".join(parts[i:j]) for i, j in pairwise(ends)]

    assert results(spark, texts, cleaning.paragraphs(F.col("t"))) == [expected(t) for t in texts]


def test_paragraphs_of_one_long_sentence(spark):
    got = results(spark, ["word " * 100_000], cleaning.paragraphs(F.col("t")))
    assert len(got[0]) == 1


def stretches(sizes, most):
    """Borders of the longest stretches whose sizes sum to at most ``most``, one at least, by their running sums."""
    upto, borders = [0, *accumulate(sizes)], [0]
    while borders[-1] < len(sizes):
        at = borders[-1]
        borders.append(max(at + 1, bisect_right(upto, upto[at] + most) - 1))
    return list(pairwise(borders))


def test_pack_sentences(spark, texts):
    def expected(text):
        parts = sentence_split(text)
        return [" ".join(parts[i:j]) for i, j in stretches([len(s) for s in parts], 50)]

    assert results(spark, texts, cleaning.pack_sentences(F.col("t"), 50)) == [expected(t) for t in texts]


def test_doubled_words(spark, texts):
    expected = [re.sub(r"\b(\w+)\s+\1\b", r"\1", t, flags=re.IGNORECASE) for t in texts]
    assert results(spark, texts, cleaning.drop_doubled_words(F.col("t"))) == expected


def test_caption_layout(spark, texts):
    def packed(text):
        words = text.split()
        # every word with the space before it, the first one's space included in the limit
        return [" ".join(words[i:j]) for i, j in stretches([len(w) + 1 for w in words], 85)] or [""]

    def balanced(t):
        words = t.split()
        if len(t) <= 42:
            return t
        splits = [(" ".join(words[:k]), " ".join(words[k:])) for k in range(1, len(words))]
        fitting = [(abs(len(a) - len(b)), k) for k, (a, b) in enumerate(splits) if max(len(a), len(b)) <= 42]
        k = min(fitting)[1] if fitting else len(words) // 2 - 1
        return r"\N".join(splits[k]) if splits else t

    got = results(spark, texts, pack_captions(F.col("t")))
    assert got == [packed(t) for t in texts]
    lines = results(spark, texts, F.transform(pack_captions(F.col("t")), lambda x: balanced_lines(x)))
    assert lines == [[balanced(c) for c in packed(t)] for t in texts]
    middle = results(spark, texts, F.transform(pack_captions(F.col("t")), lambda x: middle_lines(x)))
    for captions in middle:
        assert all(max(map(len, c.split(r"\N"))) <= 42 for c in captions if r"\N" in c)


def test_language_decides(spark):
    rows = [
        (1, "pt", "eu moro perto do rio. eu gosto daqui."),
        (2, "en", "yesterday i went home. i was tired, um, of ai."),
    ]
    got = {r.media_id: r.text for r in clean_transcripts(spark.createDataFrame(rows, "media_id long, language string, text string")).collect()}
    assert " EU " not in f" {got[1]} "
    assert " I went" in got[2] and " um" not in got[2] and "AI." in got[2]


def test_filler_report(spark):
    from cuemill.catalog.text_queries import report_fillers

    rows = [(1, "um I think, you know, that um it works"), (2, "nothing here")]
    got = report_fillers(spark.createDataFrame(rows, "media_id long, text string")).collect()
    assert Counter({(r.media_id, r.filler): r.uses for r in got}) == Counter({(1, "um"): 2, (1, "you know"): 1})
