"""Phrases that transcripts repeat: collocations by mergeable Misra-Gries summaries.

First pass: every task counts the n-grams of its texts by fingerprint and sends
the counts, as summaries of the hash partitions of all fingerprints, to one task
for each partition. That task merges them into a Misra-Gries summary: while there
are more counters than its capacity, the same amount is taken from all of them.
The capacity is above the partition's share of all n-grams divided by the least
count asked for, so less than that count is ever taken: every frequent n-gram
keeps a counter. What was taken is added up; should a partition get more than its
share, its capacity grows instead of taking more. Second pass: the texts again,
now with the phrases themselves, counting exactly those that kept a counter.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuemill.llm.batches import slices, utf8
from cuemill.llm.bits import bit_table, holds
from cuemill.llm.stored import stored
from cuemill.llm.words import LOWER, fingerprints, mix, spans, windows

LONGEST = 4
# Counters of a hash partition's summary.
CAPACITY = 1 << 19
# n-grams that a task counts before it sends them on, and phrases likewise.
_GRAMS, _PHRASES = 1 << 20, 1 << 18
# Bits of the table of kept n-grams: so many for each, within these powers of two.
_BITS_EACH, _LEAST_BITS, _MOST_BITS = 16, 20, 28
# A fingerprint's low bits tell n-grams of a partition apart; those above choose the partition.
_LOW = 40

_bytes = np.arange(256)
ENDS_PIECE = np.isin(_bytes, [ord(c) for c in ".,;:!?\n\v\f\r"])
IN_WORD = ~(ENDS_PIECE | np.isin(_bytes, [32, 9]))


class Words:
    """The words of some texts: where they begin in a buffer that holds them with single spaces between."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray):
        raw = LOWER[raw]
        starts, ends, at = spans(raw, offsets, IN_WORD)
        self.prints = fingerprints(raw, starts, ends)
        self.count = np.diff(at)
        self.text = np.repeat(np.arange(len(self.count)), self.count)
        # words of one run stand in one piece of one text
        broken = np.ones(len(starts), bool)
        before = np.cumsum(ENDS_PIECE[raw])[starts]
        broken[1:] = (before[1:] != before[:-1]) | (self.text[1:] != self.text[:-1])
        self.run = np.cumsum(broken)
        self.at = np.concatenate(([0], np.cumsum(ends - starts + 1)))
        letters = np.ones(self.at[-1], bool)
        letters[self.at[1:] - 1] = False
        self.buffer = np.full(self.at[-1], 32, np.uint8)
        self.buffer[letters] = raw[IN_WORD[raw]]

    def grams(self, n: int, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first word, fingerprint) of every n words in a row; ``seeds`` has a number for each text's language."""
        g = windows(self.prints, n)
        first = np.flatnonzero(self.run[: len(g)] == self.run[n - 1 : n - 1 + len(g)])
        return first, mix(g[first] ^ seeds[self.text[first]])

    def phrases(self, first: np.ndarray, size: np.ndarray) -> pa.Array:
        """The texts of ``size`` words from each ``first`` one."""
        low, high = self.at[first], self.at[first + size] - 1
        at = np.concatenate(([0], np.cumsum(high - low)))
        place = np.repeat(low - at[:-1], high - low) + np.arange(at[-1])
        data = pa.py_buffer(self.buffer[place].tobytes())
        return pa.Array.from_buffers(pa.large_string(), len(first), [None, pa.py_buffer(at.astype(np.int64)), data])


def _seeds(languages: pa.Array) -> np.ndarray:
    coded = languages.dictionary_encode()
    digests = [hashlib.blake2b(x.encode(), digest_size=8).digest() for x in coded.dictionary.to_pylist()]
    return np.frombuffer(b"".join(digests), np.uint64)[coded.indices.to_numpy()]


def _keys(g: np.ndarray, parts: int) -> np.ndarray:
    """Hash partition and low bits of fingerprints in one number."""
    low = np.uint64(_LOW)
    part = ((g >> low) * np.uint64(parts)) >> np.uint64(64 - _LOW)
    return (part << low) | (g & np.uint64((1 << _LOW) - 1))


def merged(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sums of their counts."""
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def pruned(
    keys: np.ndarray, counts: np.ndarray, taken: int, capacity: int, least: int
) -> tuple[np.ndarray, np.ndarray, int, int]:
    """A summary with no more counters than its capacity -> keys, counts, what was taken so far, capacity.

    The amount is that of the largest counter beyond the capacity. If all that
    was taken would reach ``least``, the capacity is doubled until it doesn't.
    """
    while len(counts) > capacity:
        amount = int(np.partition(counts, len(counts) - capacity - 1)[len(counts) - capacity - 1])
        if taken + amount < least:
            counts = counts - amount
            kept = counts > 0
            return keys[kept], counts[kept], taken + amount, capacity
        capacity *= 2
    return keys, counts, taken, capacity


def _summaries(transcripts: DataFrame, parts: int) -> DataFrame:
    """(part, keys, counts, large): the tasks' counts of n-grams, packed; counts from 255 on are in ``large``."""

    def packed(keys: list[np.ndarray], counts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        k, c = merged(np.concatenate(keys), np.concatenate(counts))
        part = (k >> np.uint64(_LOW)).astype(np.int64)
        at = np.searchsorted(part, np.arange(parts + 1))
        rows = [], [], [], []
        for p in np.flatnonzero(np.diff(at)).tolist():
            mine, n = k[at[p] : at[p + 1]], c[at[p] : at[p + 1]]
            rows[0].append(p)
            rows[1].append(np.ascontiguousarray(mine.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : _LOW // 8]).tobytes())
            rows[2].append(np.minimum(n, 255).astype(np.uint8).tobytes())
            rows[3].append(n[n >= 255].tobytes())
        kinds = [pa.int32(), pa.binary(), pa.binary(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(r, t) for r, t in zip(rows, kinds, strict=True)], ["part", "keys", "counts", "large"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list[np.ndarray] = []
        counts: list[np.ndarray] = []
        held = 0
        for batch in batches:
            raw, offsets = utf8(batch.column(0))
            seeds = _seeds(batch.column(1))
            for i, j in slices(offsets):
                w = Words(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                g = [w.grams(n, seeds[i:j])[1] for n in range(1, LONGEST + 1)]
                k, c = np.unique(_keys(np.concatenate(g), parts), return_counts=True)
                keys.append(k)
                counts.append(c)
                held += len(k)
                if held > _GRAMS:
                    yield from packed(keys, counts)
                    keys, counts, held = [], [], 0
        if held:
            yield from packed(keys, counts)

    return transcripts.select("text", "language").mapInArrow(run, "part int, keys binary, counts binary, large binary")


def _survivors(summaries: DataFrame, parts: int, least: int) -> DataFrame:
    """(key) of all n-grams that may occur ``least`` times: one Misra-Gries summary for each hash partition."""
    capacity = CAPACITY
    width = _LOW // 8

    def decoded(keys: bytes, counts: bytes, large: bytes) -> tuple[np.ndarray, np.ndarray]:
        wide = np.zeros((len(counts), 8), np.uint8)
        wide[:, :width] = np.frombuffer(keys, np.uint8).reshape(-1, width)
        n = np.frombuffer(counts, np.uint8).astype(np.int64)
        n[n == 255] = np.frombuffer(large, np.int64)
        return wide.view("<u8").reshape(-1), n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # of each partition of this task: keys, counts, taken, capacity, and what is not merged yet
        state: dict[int, list] = {}

        def merge(s: list) -> None:
            keys, counts = merged(np.concatenate([s[0], *s[4]]), np.concatenate([s[1], *s[5]]))
            s[:] = [*pruned(keys, counts, s[2], s[3], least), [], [], 0]

        for batch in batches:
            for i in range(batch.num_rows):
                part, *packed = (batch.column(k)[i].as_py() for k in range(4))
                new = [np.zeros(0, np.uint64), np.zeros(0, np.int64), 0, capacity, [], [], 0]
                s = state.setdefault(part, new)
                keys, counts = decoded(*packed)
                s[4].append(keys)
                s[5].append(counts)
                s[6] += len(keys)
                if s[6] > s[3]:
                    merge(s)
        for part, s in state.items():
            merge(s)
            kept = s[0][s[1] + s[2] >= least] | np.uint64(part << _LOW)
            yield pa.RecordBatch.from_arrays([pa.array(kept.view(np.int64))], ["key"])

    return summaries.repartitionById(parts, F.col("part")).mapInArrow(run, "key long")


def _counted(transcripts: DataFrame, kept: DataFrame, parts: int) -> DataFrame:
    """(language, phrase, size, f): exact counts of phrases that were kept, and with a null phrase those of all words."""
    bits = min(max(math.ceil(math.log2(max(kept.count(), 1) * _BITS_EACH)), _LEAST_BITS), _MOST_BITS)
    table = transcripts.sparkSession.sparkContext.broadcast(bit_table(kept, F.col("key"), bits))

    def rows(found: list[tuple]) -> pa.RecordBatch:
        g, size, count, language, phrase = zip(*found, strict=True)
        _, first, of = np.unique(np.concatenate(g), return_index=True, return_inverse=True)
        take = pa.array(first)
        total = np.bincount(of, weights=np.concatenate(count)).astype(np.int64)
        return pa.RecordBatch.from_arrays(
            [
                pa.chunked_array(language).take(take).combine_chunks(),
                pa.chunked_array(phrase).take(take).combine_chunks().cast(pa.string()),
                pa.array(np.concatenate(size)[first].astype(np.int32)),
                pa.array(total),
            ],
            ["language", "phrase", "size", "f"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple] = []
        n_words: dict[str, int] = {}
        held = 0
        for batch in batches:
            raw, offsets = utf8(batch.column(0))
            seeds = _seeds(batch.column(1))
            for i, j in slices(offsets):
                w = Words(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                languages = batch.column(1).slice(i, j - i)
                for language, n in zip(languages.to_pylist(), w.count.tolist(), strict=True):
                    n_words[language] = n_words.get(language, 0) + n
                g, first, size = [], [], []
                for n in range(1, LONGEST + 1):
                    place, h = w.grams(n, seeds[i:j])
                    known = holds(table.value, _keys(h, parts))
                    g.append(h[known])
                    first.append(place[known])
                    size.append(np.full(len(g[-1]), n))
                g, at, count = np.unique(np.concatenate(g), return_index=True, return_counts=True)
                first, size = np.concatenate(first)[at], np.concatenate(size)[at]
                found.append((g, size, count, languages.take(pa.array(w.text[first])), w.phrases(first, size)))
                held += len(g)
                if held > _PHRASES:
                    yield rows(found)
                    found, held = [], 0
        if held:
            yield rows(found)
        if n_words:
            n = len(n_words)
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(n_words), pa.string()), pa.nulls(n, pa.string()), pa.array([0] * n, pa.int32()), pa.array(list(n_words.values()), pa.int64())],
                ["language", "phrase", "size", "f"],
            )

    found = transcripts.select("text", "language").mapInArrow(run, "language string, phrase string, size int, f long")
    return found.groupBy("language", "phrase", "size").agg(F.sum("f").alias("f"))


def _joined(words: Column, low, n) -> Column:
    return F.array_join(F.slice(words, low, n), " ")


def mine_phrases(transcripts: DataFrame, least: int = 30, top: int = 2000, inside: int = 80) -> DataFrame:
    """The phrases that hold together most in each language of transcripts (text, language).

    -> language, rank, phrase, a, l, r, n, score. Texts, A-Z in lower case, are
    pieces between the marks ``. , ; : ! ?`` and line ends; their words are what
    spaces and tabs divide. A phrase is 2 to 4 words of a piece that occur ``a`` >=
    ``least`` times in the language, overlapping ones included. Cut after some of its
    words into parts that occur l and r times, it scores floor(2000000 a / (l + r));
    the cut that scores least counts, the first one of several. Phrases within a
    longer phrase that has ``inside`` % of their occurrences or more are left out. The
    ``top`` first ones by score, a (falling) and phrase (rising) are ranked from 1; n
    counts the language's words. A null language is ``und``; null and empty texts
    have no words. Repeated rows count each. Other columns are not looked at.
    Fingerprints have 64 bits: counts of two phrases in one task are confused with a
    chance of about n^2 / 2^65 for n distinct ones.
    """
    rows = transcripts.select("text", F.coalesce("language", F.lit("und")).alias("language"))
    # a word and the mark after it take two bytes at least, so there are no more n-grams than this
    most = LONGEST * (rows.agg(F.sum((F.octet_length("text") + 1) / 2).alias("n")).first()["n"] or 0)
    parts = max(math.ceil(most / (least * CAPACITY)), transcripts.sparkSession.sparkContext.defaultParallelism)
    kept = stored(_survivors(_summaries(rows, parts), parts, least))
    counted = stored(_counted(rows, kept, parts).filter(F.col("phrase").isNull() | (F.col("f") >= least)))

    phrases = counted.filter("size > 1").select("language", "phrase", F.col("f").alias("a"), "size", F.split("phrase", " ").alias("w"))
    w, size = F.col("w"), F.col("size")
    cut = F.explode(F.sequence(F.lit(1), size - 1)).alias("k")
    cuts = phrases.select("language", "phrase", "a", "size", "w", cut)
    cuts = cuts.select("language", "phrase", "a", "k", _joined(w, F.lit(1), F.col("k")).alias("left"), _joined(w, F.col("k") + 1, size).alias("right"))
    for part, count in (("left", "l"), ("right", "r")):
        known = counted.filter("phrase is not null").select("language", F.col("phrase").alias(part), F.col("f").alias(count))
        cuts = cuts.join(known, ["language", part])
    wide = {c: F.col(c).cast("decimal(30,0)") for c in ("a", "l", "r")}
    scored = cuts.withColumn("score", F.expr("(cast(a as decimal(30,0)) * 2000000) div (cast(l as decimal(30,0)) + r)").cast("long"))
    best = scored.groupBy("language", "phrase").agg(F.min(F.struct("score", "k", "l", "r")).alias("c"), F.first("a").alias("a"))

    pairs = F.flatten(
        F.transform(F.sequence(F.lit(2), size - 1), lambda n: F.transform(F.sequence(F.lit(1), size - n + 1), lambda i: _joined(w, i, n)))
    )
    longer = phrases.filter("size > 2").select("language", F.explode(F.array_distinct(pairs)).alias("phrase"), "a")
    longer = longer.groupBy("language", "phrase").agg(F.max("a").alias("around"))
    covered = F.col("around").cast("decimal(30,0)") * 100 >= wide["a"] * inside
    alone = best.join(longer, ["language", "phrase"], "left").filter(~F.coalesce(covered, F.lit(False)))

    first = Window.partitionBy("language").orderBy(F.desc("c.score"), F.desc("a"), "phrase")
    ranked = alone.withColumn("rank", F.row_number().over(first).cast("long")).filter(F.col("rank") <= top)
    n = counted.filter("phrase is null").select("language", F.col("f").alias("n"))
    return ranked.join(n, "language").select("language", "rank", "phrase", "a", "c.l", "c.r", "n", "c.score")
