"""Quality of transcripts by a factorisation machine.

Features are hashed words, binned structure statistics and the binned recorded
length. Every feature has a weight and a vector of RANK numbers; the score adds
the inner products of the vectors of all pairs of features, which by
2 sum_{i<j} <v_i, v_j> x_i x_j = |sum v_i x_i|^2 - sum |v_i|^2 x_i^2 takes time
linear in the features of a transcript.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuemill.llm.batches import add_columns, slices, utf8
from cuemill.llm.sampling import bounded
from cuemill.llm.words import LOWER, NOT_BLANK, fingerprints, spans, windows

WORD_BITS, RANK, BINS = 14, 8, 12
STATISTICS = (
    "upper_share",
    "digit_share",
    "symbol_share",
    "stop_share",
    "wide_share",
    "line_share",
    "word_length",
    "words",
    "word_variety",
    "line_variety",
    "phrase_variety",
    "same_word_share",
    "n_chars",
)
_bytes = np.arange(256)
_CLASSES = {
    "upper_share": (_bytes >= 65) & (_bytes <= 90),
    "digit_share": (_bytes >= 48) & (_bytes <= 57),
    "symbol_share": np.isin(_bytes, [ord(c) for c in "!\"#$%&*+/<=>@[\\]^_`{|}~"]),
    "stop_share": np.isin(_bytes, [ord(c) for c in ".,;:?"]),
    "wide_share": _bytes >= 128,
    "line_share": _bytes == 10,
}
_NOT_NEWLINE = _bytes != 10


def _distinct_share(keys: np.ndarray, at: np.ndarray, empty: float = 1.0) -> np.ndarray:
    """Of every text the distinct entries among its entries at[i] to at[i + 1]."""
    size = np.diff(at)
    text = np.repeat(np.arange(len(size)), size)
    order = np.lexsort((keys, text))
    keys, text = keys[order], text[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (text[1:] != text[:-1])
    return np.where(size > 0, np.bincount(text, new, len(size)) / np.maximum(size, 1), empty)


def features(texts: pa.Array, n_chars: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of every text: statistics (rows), and hashed words as (at, bucket, value) lists.

    The words of a text have values log(1 + uses), scaled to length 1 together.
    """
    raw, offsets = utf8(texts)
    n = len(offsets) - 1
    stats = np.zeros((n, len(STATISTICS)))
    counts, buckets, values = [np.zeros(1, np.int64)], [], []
    for i, j in slices(offsets):
        part, at = raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        size = np.maximum(np.diff(at), 1)
        for k, name in enumerate(STATISTICS):
            if name in _CLASSES:
                sums = np.concatenate(([0], np.cumsum(_CLASSES[name][part], dtype=np.int64)))
                stats[i:j, k] = (sums[at[1:]] - sums[at[:-1]]) / size
        low = LOWER[part]
        starts, ends, word_at = spans(low, at, NOT_BLANK)
        w = fingerprints(low, starts, ends)
        n_words = np.diff(word_at)
        lengths = np.concatenate(([0], np.cumsum(ends - starts)))
        line_starts, line_ends, line_at = spans(low, at, _NOT_NEWLINE)
        phrases = windows(w, 3)
        text_of = np.repeat(np.arange(j - i), n_words)
        inside = np.flatnonzero(text_of[: len(phrases)] == text_of[2:]) if len(phrases) else np.zeros(0, np.int64)
        phrase_at = np.searchsorted(inside, word_at)
        same = np.zeros(len(w) + 1)
        if len(w) > 1:
            np.cumsum((w[1:] == w[:-1]) & (text_of[1:] == text_of[:-1]), out=same[2:])
        put = lambda name, value: stats.__setitem__((slice(i, j), STATISTICS.index(name)), value)  # noqa: E731, B023
        put("word_length", (lengths[word_at[1:]] - lengths[word_at[:-1]]) / np.maximum(n_words, 1))
        put("words", np.log2(1 + n_words))
        put("word_variety", _distinct_share(w, word_at))
        put("line_variety", _distinct_share(fingerprints(low, line_starts, line_ends), line_at))
        put("phrase_variety", _distinct_share(phrases[inside], phrase_at))
        put("same_word_share", (same[word_at[1:]] - same[word_at[:-1]]) / np.maximum(n_words, 1))
        key = (text_of.astype(np.int64) << WORD_BITS) | (w >> np.uint64(64 - WORD_BITS)).astype(np.int64)
        key, uses = np.unique(key, return_counts=True)
        text, value = key >> WORD_BITS, np.log1p(uses)
        norm = np.sqrt(np.bincount(text, value * value, j - i))
        counts.append(np.bincount(text, minlength=j - i))
        buckets.append(key & ((1 << WORD_BITS) - 1))
        values.append(value / norm[text])
    recorded = n_chars.cast(pa.float64()).to_numpy(zero_copy_only=False)
    stats[:, -1] = np.where(np.isfinite(recorded), np.log2(1 + np.maximum(np.nan_to_num(recorded), 0)), -1)
    at = np.cumsum(np.concatenate(counts))
    return stats, at, np.concatenate(buckets or [np.zeros(0, np.int64)]), np.concatenate(values or [np.zeros(0)])


@dataclass
class QualityModel:
    """Bins of the statistics, and the bias, weights and vectors of words and bins."""

    edges: np.ndarray  # (statistics, BINS - 1)
    bias: float
    weights: np.ndarray
    vectors: np.ndarray

    def rows(self, stats: np.ndarray, at: np.ndarray, bucket: np.ndarray, value: np.ndarray):
        """All features as lists: the words, then one bin per statistic."""
        n, k = stats.shape
        size = np.diff(at)
        out_at = at + k * np.arange(n + 1)
        index, x = np.zeros(out_at[-1], np.int64), np.full(out_at[-1], 0.5)
        words = np.arange(len(bucket)) + k * np.repeat(np.arange(n), size)
        index[words], x[words] = bucket, value
        for s in range(k):
            place = out_at[1:] - k + s
            index[place] = (1 << WORD_BITS) + s * BINS + np.searchsorted(self.edges[s], stats[:, s], side="right")
        return out_at, index, x

    def margins(self, at: np.ndarray, index: np.ndarray, x: np.ndarray) -> np.ndarray:
        if len(at) < 2:
            return np.zeros(0)
        v = self.vectors[index] * x[:, None]
        # every text has its statistics, so no segment is empty
        total = np.add.reduceat(v, at[:-1], axis=0)
        squares = np.add.reduceat((v * v).sum(axis=1), at[:-1])
        linear = np.add.reduceat(self.weights[index] * x, at[:-1])
        return self.bias + linear + 0.5 * ((total * total).sum(axis=1) - squares)


def _fit(model: QualityModel, at, index, x, y, epochs: int = 12, batch: int = 64, rate: float = 0.05) -> None:
    """Adaptive gradient descent on the log loss, in a fixed order of shuffles."""
    random = np.random.default_rng(7)
    n_features = len(model.weights)
    seen_w, seen_v, seen_b = np.full(n_features, 1e-6), np.full((n_features, RANK), 1e-6), 1e-6
    for _ in range(epochs):
        order = random.permutation(len(y))
        for k in range(0, len(order), batch):
            rows = order[k : k + batch]
            size = at[rows + 1] - at[rows]
            begin = np.concatenate(([0], np.cumsum(size)))
            place = np.repeat(at[rows] - begin[:-1], size) + np.arange(begin[-1])
            idx, val = index[place], x[place]
            error = 1 / (1 + np.exp(-np.clip(model.margins(begin, idx, val), -30, 30))) - y[rows]
            each = np.repeat(error, size) / len(rows)
            v = model.vectors[idx] * val[:, None]
            total = np.repeat(np.add.reduceat(v, begin[:-1], axis=0), size, axis=0)
            used, to = np.unique(idx, return_inverse=True)
            g_w = np.bincount(to, each * val) + 1e-5 * model.weights[used]
            g_v = np.zeros((len(used), RANK))
            np.add.at(g_v, to, (each * val)[:, None] * (total - v))
            g_v += 1e-4 * model.vectors[used]
            seen_w[used] += g_w * g_w
            seen_v[used] += g_v * g_v
            seen_b += error.mean() ** 2
            model.weights[used] -= rate * g_w / np.sqrt(seen_w[used])
            model.vectors[used] -= rate * g_v / np.sqrt(seen_v[used])
            model.bias -= rate * error.mean() / np.sqrt(seen_b)


_LISTS = "stats array<double>, bucket array<int>, value array<float>"


def _ready(transcripts: DataFrame) -> DataFrame:
    """Transcripts with a recorded length, null where they have none."""
    if "n_chars" in transcripts.columns:
        return transcripts.withColumn("n_chars", F.col("n_chars").try_cast("double"))
    return transcripts.withColumn("n_chars", F.lit(None).cast("double"))


def learn_quality(labelled: DataFrame, sample_rows: int = 6_000) -> QualityModel:
    """Model from labelled transcripts (media_id, text, quality 0 or 1; n_chars if there is one).

    ``sample_rows`` bounds, on average, the labelled rows that are read; rows
    without a label are left out. Features are made in Spark, and those of the
    sample reach the driver. Without rows every score is 0.5.
    """
    rows = _ready(labelled).filter("quality is not null")
    rows = bounded(rows.select("media_id", "text", "n_chars", F.col("quality").cast("int").alias("quality")), sample_rows)

    def work(columns):
        stats, at, bucket, value = features(columns["text"], columns["n_chars"])
        at = pa.array(at.astype(np.int32))
        return {
            "stats": pa.array(list(stats), pa.list_(pa.float64())),
            "bucket": pa.ListArray.from_arrays(at, pa.array(bucket.astype(np.int32))),
            "value": pa.ListArray.from_arrays(at, pa.array(value.astype(np.float32))),
        }

    found = add_columns(rows, ["text", "n_chars"], ["media_id", "quality"], _LISTS, work).toArrow()
    found = found.sort_by([("media_id", "ascending")]).combine_chunks()
    n_features = (1 << WORD_BITS) + len(STATISTICS) * BINS
    random = np.random.default_rng(11)
    model = QualityModel(
        np.zeros((len(STATISTICS), BINS - 1)), 0.0, np.zeros(n_features), random.normal(0, 0.01, (n_features, RANK))
    )
    if not found.num_rows:
        model.vectors[:] = 0
        return model
    lists = found.column("bucket").combine_chunks()
    at = np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy())))
    stats = np.array(found.column("stats").to_pylist())
    bucket = lists.flatten().to_numpy().astype(np.int64)
    value = found.column("value").combine_chunks().flatten().to_numpy().astype(float)
    model.edges = np.quantile(stats, np.linspace(0, 1, BINS + 1)[1:-1], axis=0).T
    y = found.column("quality").to_numpy().astype(float)
    rate = np.clip(y.mean(), 0.01, 0.99)
    model.bias = float(np.log(rate / (1 - rate)))
    _fit(model, *model.rows(stats, at, bucket, value), y)
    return model


def score_quality(transcripts: DataFrame, model: QualityModel, keep: tuple[str, ...] = ("media_id",)) -> DataFrame:
    """``keep`` columns of transcripts (text, and n_chars if there is one) with score and predicted.

    ``score`` is the probability of the label 1, ``predicted`` 1 from 0.5 on. A
    null text counts as empty; it has no words and is scored by its statistics.
    """
    shared = transcripts.sparkSession.sparkContext.broadcast(model)

    def work(columns):
        m = shared.value
        margins = m.margins(*m.rows(*features(columns["text"], columns["n_chars"])))
        score = 1 / (1 + np.exp(-np.clip(margins, -50, 50)))
        return {"score": pa.array(score), "predicted": pa.array((score >= 0.5).astype(np.int32))}

    return add_columns(_ready(transcripts), ["text", "n_chars"], keep, "score double, predicted int", work)
