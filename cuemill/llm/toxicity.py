"""Toxic passages of transcripts by maximum-scoring segments.

A word's score is the log-odds of toxic against other transcripts under a
Dirichlet prior, less what chance explains, so that most words score below
zero. Words are counted as a whole and by their beginnings, since a stem takes
many endings. All maximal segments of a transcript are found in one pass over
its scores. Their significance follows the extreme-value law of maximal
segments: the best of n words exceeds s by chance with 1 - exp(-K n exp(-lambda s)).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuemill.llm.batches import add_columns, slices, utf8
from cuemill.llm.sampling import bounded
from cuemill.llm.words import ALNUM, LOWER, fingerprints, mix, signed, spans, windows

# Added to the counts of every word or beginning in both classes.
PRIOR = 1.0
# Bytes of the beginnings of longer words that are counted too.
STEMS = (4, 5, 6, 7, 8)
# Standard errors taken off a word's log-odds before it counts as toxic.
CAUTION = 2.33
# Taken off every word, so that segments end.
DRIFT = 0.5
# Segments by chance in a transcript at which a passage is still listed.
LISTED = 0.05
# Bytes of text worked on at once: the beginnings of its words take many times as much.
PART = 250_000


def _stems(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For every size in STEMS: which words are longer, and the fingerprints of their beginnings."""
    for size in STEMS:
        longer = np.flatnonzero(ends - starts > size)
        yield longer, mix(fingerprints(raw, starts[longer], starts[longer] + size) + np.uint64(size))


@dataclass
class ToxicityModel:
    """Scores of words and beginnings that differ from ``other`` (sorted by fingerprint), and the calibration."""

    words: np.ndarray
    word_scores: np.ndarray
    stems: np.ndarray
    stem_scores: np.ndarray
    other: float
    decay: float
    search: float
    intercept: float
    slope: float

    def of(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Scores of the words at these byte ranges of lower-case text.

        A word that is known to be harmless keeps its score; else the most
        toxic of the word and its beginnings counts.
        """
        scores = _look_up(self.words, self.word_scores, fingerprints(raw, starts, ends), self.other)
        harmless = scores < self.other
        for longer, stems in _stems(raw, starts, ends):
            scores[longer] = np.maximum(scores[longer], _look_up(self.stems, self.stem_scores, stems, self.other))
        return np.where(harmless, np.minimum(scores, self.other), scores)

    def strength(self, best: np.ndarray, n: np.ndarray) -> np.ndarray:
        """lambda s - ln(K n): minus the log of the segments as good expected by chance."""
        return self.decay * best - np.log(self.search * np.maximum(n, 1))

    def chance(self, best: np.ndarray, n: np.ndarray) -> np.ndarray:
        return -np.expm1(-np.exp(np.minimum(-self.strength(best, n), 50.0)))

    def probability(self, best: np.ndarray, n: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.intercept + self.slope * self.strength(best, n), -50, 50)))


def _look_up(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, other: float) -> np.ndarray:
    if not len(keys):
        return np.full(len(wanted), other)
    at = np.searchsorted(keys, wanted).clip(max=len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], other)


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, past, score) in order, in linear time.

    Only where the sign changes can a segment begin or end: runs of positive
    words and the gaps between them are summed first, and the scan goes over
    the runs.
    """
    up = scores > 0
    if not up.any():
        return []
    edges = np.flatnonzero(np.diff(np.concatenate(([False], up, [False])).astype(np.int8)))
    first, past = edges[0::2], edges[1::2]
    sums = np.concatenate(([0.0], np.cumsum(scores)))
    # open candidates: first word, past word, running total before it and with it
    found: list[tuple[int, int, float, float]] = []
    # for every candidate the last one before it that began at a lower total
    lower: list[int] = []
    for a, b in zip(first.tolist(), past.tolist(), strict=True):
        left, right = float(sums[a]), float(sums[b])
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= left:
                j = lower[j]
            if j < 0 or found[j][3] >= right:
                found.append((a, b, left, right))
                lower.append(j)
                break
            a, left = found[j][0], found[j][2]
            del found[j:], lower[j:]
    return [(a, b, right - left) for a, b, left, right in found]


def _contexts(labelled: DataFrame) -> DataFrame:
    """(toxic, word, uses): in how many different neighbourhoods a word stands, so that copies of a text count once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic = batch.column(1).to_numpy(zero_copy_only=False)
            raw, offsets = utf8(batch.column(0))
            for i, j in slices(offsets, PART):
                part = LOWER[raw[offsets[i] : offsets[j]]]
                starts, ends, at = spans(part, offsets[i : j + 1] - offsets[i], ALNUM)
                if not len(starts):
                    continue
                w = fingerprints(part, starts, ends)
                edge = np.zeros(len(w) + 1, bool)
                edge[at] = True
                before = np.where(edge[:-1], np.uint64(0), np.roll(w, 1))
                after = np.where(edge[1:], np.uint64(0), np.roll(w, -1))
                around = windows(np.column_stack([before, w, after]).reshape(-1), 3)[::3]
                text = part.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.repeat(toxic[i:j], np.diff(at)).astype(np.int32)),
                        pa.array([text[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], pa.binary()),
                        pa.array(signed(around)),
                    ],
                    ["toxic", "word", "around"],
                )

    rows = labelled.select("text", "toxic").mapInArrow(run, "toxic int, word binary, around long").distinct()
    return rows.groupBy("toxic", "word").agg(F.count("*").alias("uses"))


def _summed(keys: np.ndarray, bad: np.ndarray, good: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    keys, at = np.unique(keys, return_inverse=True)
    return keys, np.bincount(at, bad, len(keys)), np.bincount(at, good, len(keys))


def _odds(keys: np.ndarray, bad: np.ndarray, good: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and their scores: log-odds drawn towards 0 by CAUTION standard errors, less the drift."""
    keys, bad, good = _summed(keys, bad, good)
    n_bad, n_good = bad.sum() + PRIOR * (len(keys) + 1), good.sum() + PRIOR * (len(keys) + 1)
    odds = np.log((bad + PRIOR) / (n_bad - bad)) - np.log((good + PRIOR) / (n_good - good))
    error = CAUTION * np.sqrt(1 / (bad + PRIOR) + 1 / (good + PRIOR))
    return keys, np.where(odds > 0, np.maximum(odds - error, 0), np.minimum(odds + error, 0)) - DRIFT


def _word_model(counts: pa.Table) -> ToxicityModel:
    toxic, uses = counts.column("toxic").to_numpy(), counts.column("uses").to_numpy()
    raw, offsets = utf8(counts.column("word").cast(pa.string()))
    starts, ends = offsets[:-1], offsets[1:]
    bad, good = np.where(toxic == 1, uses, 0), np.where(toxic == 1, 0, uses)
    words, word_scores = _odds(fingerprints(raw, starts, ends), bad, good)
    # one size after the other, so that the driver holds one size's words at a time
    found = [_summed(stems, bad[longer], good[longer]) for longer, stems in _stems(raw, starts, ends)]
    stems, stem_scores = _odds(*(np.concatenate(c) for c in zip(*found, strict=True)))
    # those that score as unknown ones do need no entry
    told, stem_told = np.abs(word_scores + DRIFT) > 1e-6, stem_scores + DRIFT > 1e-6
    model = ToxicityModel(
        words[told], word_scores[told], stems[stem_told], stem_scores[stem_told], -DRIFT, 1.0, 1.0, -30.0, 1e-3
    )
    scores = model.of(raw, starts, ends)
    share = (good + PRIOR) / max((good + PRIOR).sum(), 1.0)
    model.decay = _decay(scores, share)
    tilted = share[scores > 0] * np.exp(np.minimum(model.decay * scores[scores > 0], 700))
    model.search = float(min(max(tilted.sum(), 1e-6), 1.0))
    return model


def _decay(scores: np.ndarray, share: np.ndarray) -> float:
    """The positive root of sum share * exp(lambda * score) = 1."""
    top = scores.max(initial=0.0)
    if top <= 0:
        return 1.0
    low, high = 0.0, 1.0
    value = lambda x: float(np.sum(share * np.exp(np.minimum(x * scores, 700)))) - float(share.sum())
    while value(high) < 0 and high < 1e3:
        low, high = high, 2 * high
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if value(mid) < 0 else (low, mid)
    return high


def _best(texts: pa.Array, model: ToxicityModel, listed: bool):
    """Number of words and best segment of every text; with ``listed``, significant passages as word ranges too."""
    raw, offsets = utf8(texts)
    n, best, passages = np.zeros(len(texts), np.int64), np.zeros(len(texts)), [[] for _ in range(len(texts))]
    for i, j in slices(offsets, PART):
        part = LOWER[raw[offsets[i] : offsets[j]]]
        starts, ends, at = spans(part, offsets[i : j + 1] - offsets[i], ALNUM)
        n[i:j] = np.diff(at)
        scores = model.of(part, starts, ends)
        for k in np.unique(np.searchsorted(at, np.flatnonzero(scores > 0), side="right") - 1).tolist():
            found = segments(scores[at[k] : at[k + 1]])
            best[i + k] = max(s for _, _, s in found)
            if listed:
                sizes = np.array([s for _, _, s in found])
                chance = model.chance(sizes, np.full(len(sizes), n[i + k]))
                passages[i + k] = [
                    {"from": a, "to": b, "score": s} for (a, b, s), p in zip(found, chance, strict=True) if p <= LISTED
                ]
    return n, best, passages


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Intercept and slope, kept from running off by a weak pull towards (0, 1)."""
    a, b = 0.0, 1.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a + b * x, -30, 30)))
        g = np.array([np.sum(p - y) + 0.01 * a, np.sum((p - y) * x) + 0.01 * (b - 1)])
        q = p * (1 - p)
        h = np.array([[q.sum() + 0.01, (q * x).sum()], [(q * x).sum(), (q * x * x).sum() + 0.01]])
        step = np.linalg.solve(h, g)
        step *= min(1.0, 4 / max(np.abs(step).max(), 1e-9))
        a, b = a - step[0], max(b - step[1], 1e-3)
        if np.abs(step).max() < 1e-8:
            break
    return float(a), float(b)


def learn_toxicity(labelled: DataFrame, sample_rows: int = 10_000) -> ToxicityModel:
    """Model from labelled transcripts (media_id, text, toxic 0 or 1).

    ``sample_rows`` bounds the labelled rows that are read, on average; rows
    without a label are left out. Words are counted in Spark; the counts of the
    words of the sample and one pair of numbers per sampled row reach the
    driver. Without rows, or with one class only, nothing scores as toxic.
    """
    rows = labelled.filter("toxic is not null").select("media_id", "text", F.col("toxic").cast("int").alias("toxic"))
    rows = bounded(rows, sample_rows)
    model = _word_model(_contexts(rows).toArrow())

    def work(columns):
        n, best, _ = _best(columns["text"], model, False)
        return {"n_words": pa.array(n), "best": pa.array(best)}

    seen = add_columns(rows, ["text"], ["toxic"], "n_words long, best double", work).toArrow()
    toxic, n, best = (seen.column(c).to_numpy() for c in ("toxic", "n_words", "best"))
    if len(set(toxic.tolist())) < 2:
        return model
    model.intercept, model.slope = _logistic(model.strength(best, n), toxic)
    return model


def score_toxicity(
    transcripts: DataFrame, model: ToxicityModel, keep: tuple[str, ...] = ("media_id",), threshold: float = 0.7
) -> DataFrame:
    """``keep`` columns of transcripts (text) with n_words, score, predicted and the significant passages.

    ``passages`` are word ranges (from, to, score) of segments that chance gives
    with a probability of at most 5 % in a transcript of that length. ``score``
    is the probability of the label 1 given the best segment, by a logistic
    curve fitted over its extreme-value strength; ``predicted`` is 1 from
    ``threshold`` on. A text without words (or null) is scored as one of no
    toxic word. Rows stay rows: equal ones get equal results.
    """
    shared = transcripts.sparkSession.sparkContext.broadcast(model)

    def work(columns):
        m = shared.value
        n, best, passages = _best(columns["text"], m, True)
        score = m.probability(best, n)
        return {
            "n_words": pa.array(n),
            "score": pa.array(score),
            "predicted": pa.array((score >= threshold).astype(np.int32)),
            "passages": pa.array(
                passages, pa.list_(pa.struct([("from", pa.int32()), ("to", pa.int32()), ("score", pa.float64())]))
            ),
        }

    adds = "n_words long, score double, predicted int, passages array<struct<from: int, to: int, score: double>>"
    return add_columns(transcripts, ["text"], keep, adds, work)
