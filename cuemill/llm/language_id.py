"""Languages of transcripts by prediction by partial matching.

Each language has a tree of byte contexts of up to ORDER bytes. The code length
of a byte after a context is -log2 of its share there (escape method C); a byte
not seen in the context costs the context's escape and is coded in the next
shorter one, over the bytes not yet excluded, down to a uniform byte. With the
statistics frozen, a text's code length is a sum over its (ORDER + 1)-byte
windows, so it is looked up and not walked.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuemill.llm.batches import add_columns, utf8
from cuemill.llm.sampling import draw

ORDER = 4
# More languages than this are an error, since a model holds a tree for each.
LANGUAGES = 1_000
# Transcripts of a language expected in its sample, below which one of them is kept in any case.
_FEW = 20
# Positions coded at once.
_STRIDE = 1 << 18


def _padded(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts one after the other, ORDER zero bytes before each, and where each then begins."""
    at = offsets + ORDER * np.arange(len(offsets))
    out = np.zeros(len(raw) + ORDER * (len(offsets) - 1), np.uint8)
    keep = np.ones(len(out), bool)
    for k in range(ORDER):
        keep[at[:-1] + k] = False
    out[keep] = raw
    return out, at


def _windows(data: np.ndarray, size: int) -> np.ndarray:
    """The ``size`` bytes up to and with each position from ``ORDER`` on, as one number."""
    n = len(data) - ORDER
    h = np.zeros(max(n, 0), np.uint64)
    for k in range(size):
        h = (h << np.uint64(8)) | data[ORDER - size + 1 + k : ORDER - size + 1 + k + n]
    return h


class _Table:
    """Places of 64-bit keys, by open hashing over flat arrays."""

    def __init__(self, keys: np.ndarray):
        bits = max(8, int(2 * max(len(keys), 1)).bit_length())
        self.shift = np.uint64(64 - bits)
        slot = self._slot(keys)
        self.order = np.argsort(slot, kind="stable")
        self.keys = np.append(keys[self.order], np.uint64(2**64 - 1))
        self.first = np.searchsorted(slot[self.order], np.arange((1 << bits) + 1)).astype(np.int32)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, wanted: np.ndarray) -> np.ndarray:
        """Position of each wanted key in the array given at first, -1 if it isn't there."""
        slot = self._slot(wanted)
        at, end = self.first[slot], self.first[slot + 1]
        found = np.full(len(wanted), -1, np.int64)
        left = np.flatnonzero(at < end)
        at, end = at[left], end[left]
        while len(left):
            hit = self.keys[at] == wanted[left]
            found[left[hit]] = self.order[at[hit]]
            on = ~hit & (at + 1 < end)
            left, at, end = left[on], at[on] + 1, end[on]
        return found


@dataclass
class LanguageModel:
    """Per order: the windows seen in any language and their code lengths in each; the contexts and their escapes."""

    languages: list[str]
    windows: list[_Table]
    bits: list[np.ndarray]
    contexts: list[_Table]
    escapes: list[np.ndarray]

    def code_lengths(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Bits of every text (rows) in every language (columns)."""
        data, at = _padded(raw, offsets)
        total = np.zeros((len(offsets) - 1, len(self.languages)))
        for a in range(0, len(data) - ORDER, _STRIDE):
            b = min(a + _STRIDE, len(data) - ORDER)
            cost = self._costs(data[a : b + ORDER])
            # position p codes byte p + ORDER; the padding of the next text is coded by nobody
            first = np.clip(at[:-1] - a, 0, b - a)
            past = np.clip(at[1:] - ORDER - a, 0, b - a)
            sums = np.zeros((b - a + 1, len(self.languages)))
            np.cumsum(cost, axis=0, out=sums[1:])
            rows = np.flatnonzero(past > first)
            total[rows] += sums[past[rows]] - sums[first[rows]]
        return total

    def _costs(self, data: np.ndarray) -> np.ndarray:
        n = len(data) - ORDER
        cost = np.zeros((n, len(self.languages)))
        left = np.arange(n)
        for order in range(ORDER, -1, -1):
            w = _windows(data, order + 1)[left] if len(left) else np.zeros(0, np.uint64)
            found = self.windows[order].find(w)
            hit = found >= 0
            cost[left[hit]] += self.bits[order][found[hit]]
            left, w = left[~hit], w[~hit]
            context = self.contexts[order].find(w >> np.uint64(8))
            known = context >= 0
            cost[left[known]] += self.escapes[order][context[known]]
        cost[left] += 8.0
        return cost


def _counts(labelled: DataFrame) -> DataFrame:
    """(language, size, gram, n): windows of 1 to ORDER + 1 bytes and how often they occur."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = utf8(batch.column(1))
            languages = np.array(batch.column(0).to_pylist(), object)
            for language in sorted(set(languages)):
                rows = np.flatnonzero(languages == language)
                parts = [raw[offsets[k] : offsets[k + 1]] for k in rows]
                data, at = _padded(np.concatenate(parts), np.concatenate(([0], np.cumsum([len(p) for p in parts]))))
                real = np.ones(max(len(data) - ORDER, 0), bool)
                for k in range(ORDER):
                    # padding between texts is context, not text
                    inner = at[1:-1] - ORDER + k
                    real[inner[inner < len(real)]] = False
                for size in range(1, ORDER + 2):
                    grams, n = np.unique(_windows(data, size)[real], return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([language] * len(grams), pa.string()),
                            pa.array(np.full(len(grams), size, np.int32)),
                            pa.array(grams.view(np.int64)),
                            pa.array(n.astype(np.int64)),
                        ],
                        ["language", "size", "gram", "n"],
                    )

    rows = labelled.select("language", "text").mapInArrow(run, "language string, size int, gram long, n long")
    return rows.groupBy("language", "size", "gram").agg(F.sum("n").alias("n"))


def _per_language(grams: list[np.ndarray], n: list[np.ndarray]):
    """Of one language, per order: windows and code lengths, contexts and escapes."""
    out = []
    below_keys, below_bits = np.arange(256, dtype=np.uint64), np.full(256, 8.0)
    for order in range(ORDER + 1):
        keys, count = grams[order], n[order].astype(float)
        contexts, of = np.unique(keys >> np.uint64(8), return_inverse=True)
        total, kinds = np.bincount(of, count), np.bincount(of)
        bits = -np.log2(count / (total + kinds)[of])
        # what the shorter context gives to the bytes seen here is excluded when one escapes
        shorter = below_bits[np.searchsorted(below_keys, keys & np.uint64((1 << 8 * max(order, 1)) - 1))]
        excluded = np.minimum(np.bincount(of, np.exp2(-shorter)), 1 - 1e-9)
        escapes = -np.log2(kinds / (total + kinds)) + np.log2(1 - excluded)
        out.append((keys, bits, contexts, escapes))
        below_keys, below_bits = keys, bits
    return out


def learn_languages(labelled: DataFrame, sample_bytes: int = 2_000_000) -> LanguageModel:
    """Model from transcripts (media_id, text, language) whose language is known.

    Rows without a text or language are left out. ``sample_bytes`` bounds the
    text that is read per language, on average, by drawing whole transcripts, one
    at least of every language, however long its transcripts are;
    windows are counted in Spark, and the counts of that bounded text reach the
    driver. Without rows there are no languages; more than LANGUAGES raise
    ValueError.
    """
    rows = labelled.filter("text is not null and language is not null").select("media_id", "text", "language")
    mark = F.xxhash64(F.lit(19), "media_id", "text")
    sizes = rows.groupBy("language").agg(
        F.sum(F.octet_length("text")).alias("n"), F.count("*").alias("rows"), F.min(mark).alias("least")
    )
    sizes = sizes.limit(LANGUAGES + 1).collect()
    if len(sizes) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages to learn")
    share = rows.sparkSession.createDataFrame(
        [(r["language"], sample_bytes / max(r["n"], 1)) for r in sizes], "language string, share double"
    )
    # a row per language, so at most LANGUAGES: rows with text needn't be shuffled to meet it
    drawn = draw(rows.join(F.broadcast(share), "language"), F.col("share")).drop("share")
    few = [(r["language"], r["least"]) for r in sizes if r["n"] > sample_bytes and r["rows"] * sample_bytes < _FEW * r["n"]]
    if few:
        # of a few long texts perhaps none is drawn: one of them is always there
        least = F.broadcast(rows.sparkSession.createDataFrame(few, "language string, least long"))
        marked = rows.withColumn("mark", mark)
        first = marked.join(least, "language").filter("mark = least").dropDuplicates(["language"])
        drawn = drawn.withColumn("mark", mark).join(least, "language", "left").filter("least is null or mark <> least")
        drawn = drawn.select("media_id", "text", "language").union(first.select("media_id", "text", "language"))
    counts = _counts(drawn).toArrow()
    language, size = counts.column("language").to_numpy(), counts.column("size").to_numpy()
    gram, n = counts.column("gram").to_numpy().view(np.uint64), counts.column("n").to_numpy()
    languages = sorted(set(language.tolist()))
    trees = []
    for name in languages:
        grams, numbers = [], []
        for k in range(1, ORDER + 2):
            here = np.flatnonzero((language == name) & (size == k))
            here = here[np.argsort(gram[here])]
            grams.append(gram[here])
            numbers.append(n[here])
        trees.append(_per_language(grams, numbers))
    model = LanguageModel(languages, [], [], [], [])
    for order in range(ORDER + 1):
        keys = np.unique(np.concatenate([t[order][0] for t in trees])) if trees else np.zeros(0, np.uint64)
        contexts = np.unique(np.concatenate([t[order][2] for t in trees])) if trees else np.zeros(0, np.uint64)
        bits, escapes = np.zeros((len(keys), len(trees))), np.zeros((len(contexts), len(trees)))
        for k, tree in enumerate(trees):
            own, own_bits, own_contexts, own_escapes = tree[order]
            escapes[np.searchsorted(contexts, own_contexts), k] = own_escapes
            at = np.searchsorted(keys, own)
            bits[at, k] = own_bits
            unseen = np.ones(len(keys), bool)
            unseen[at] = False
            unseen = np.flatnonzero(unseen)
            # the context's escape, if the language has the context, and the code in the next shorter one
            fall = escapes[np.searchsorted(contexts, keys[unseen] >> np.uint64(8)), k]
            if order:
                mask = np.uint64((1 << 8 * order) - 1)
                fall = fall + model.bits[order - 1][model.windows[order - 1].find(keys[unseen] & mask), k]
            else:
                fall = fall + 8.0
            bits[unseen, k] = fall
        model.windows.append(_Table(keys))
        model.bits.append(bits)
        model.contexts.append(_Table(contexts))
        model.escapes.append(escapes)
    return model


def identify_languages(transcripts: DataFrame, model: LanguageModel, keep: tuple[str, ...] = ("media_id",)) -> DataFrame:
    """``keep`` columns of transcripts (text) with language_found, score and bits_per_byte, a row for each row.

    The language with the shortest code of the whole text; on a tie the first by
    name. ``score`` is its share of 2 ** -length over all languages. A text that
    is null, empty or without a letter is ``und`` with score 0, as is every text
    if nothing was learned.
    """
    shared = transcripts.sparkSession.sparkContext.broadcast(model)

    def work(columns):
        m = shared.value
        raw, offsets = utf8(columns["text"])
        n = len(offsets) - 1
        spoken = columns["_letter"].fill_null(False).to_numpy(zero_copy_only=False)
        names, score, rate = np.full(n, "und", object), np.zeros(n), np.full(n, np.nan)
        if m.languages and n:
            bits = m.code_lengths(raw, offsets)
            best = np.argmin(bits, axis=1)
            least = bits[np.arange(n), best]
            share = 1 / np.exp2(np.maximum(least[:, None] - bits, -1000)).sum(axis=1)
            names = np.where(spoken, np.array(m.languages, object)[best], "und")
            score = np.where(spoken, share, 0.0)
            rate = np.where(spoken, least / np.maximum(np.diff(offsets), 1), np.nan)
        return {
            "language_found": pa.array(names.tolist(), pa.string()),
            "score": pa.array(score),
            "bits_per_byte": pa.array(rate, mask=np.isnan(rate)),
        }

    rows = transcripts.withColumn("_letter", F.col("text").rlike(r"\p{L}"))
    return add_columns(
        rows, ["text", "_letter"], keep, "language_found string, score double, bits_per_byte double", work
    )
