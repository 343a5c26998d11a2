"""Benchmark decontamination of transcripts by winnowing.

Of every three 8-word hashes in a row (ten words) the smallest is a fingerprint,
the last one if several are equal. Equal ten-word windows choose equal
fingerprints at equal places, so fingerprints that transcripts and test items
have in common, extended by the two words before and after, show every shared
window. Items of fewer than ten words are fingerprints as a whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuemill.llm.batches import add_columns, slices, utf8
from cuemill.llm.bits import bit_table, holds
from cuemill.llm.words import ALNUM, mix, signed, windows, words

WINDOW, GRAM = 10, 8
_REACH = WINDOW - GRAM
# Bits of the table that says which hashes test items have.
_TABLE_BITS = 24
_HIT = "struct<hash: bigint, at: int, span: int, b1: bigint, b2: bigint, a1: bigint, a2: bigint>"
_FIELDS = ["hash", "at", "span", "b1", "b2", "a1", "a2"]


def _fingerprints(w: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Positions of the fingerprints of texts whose words begin at ``at``."""
    g = windows(w, GRAM)
    first = np.arange(max(len(g) - _REACH, 0))
    ends = at[np.searchsorted(at, first, side="right").clip(max=len(at) - 1)]
    first = first[first + WINDOW <= ends]
    best = first + _REACH
    for back in range(1, _REACH + 1):
        here = first + _REACH - back
        best = np.where(g[here] < g[best], here, best)
    return np.unique(best)


def _around(w: np.ndarray, at: np.ndarray, place: np.ndarray, absent: int) -> list[np.ndarray]:
    """The words before and after 8-word hashes, ``absent`` beyond the ends of the text."""
    doc = np.searchsorted(at, place, side="right") - 1
    low, high = at[doc], at[np.minimum(doc + 1, len(at) - 1)]
    found = []
    for k in (place - 1, place - 2, place + GRAM, place + GRAM + 1):
        inside = (k >= low) & (k < high)
        found.append(np.where(inside, w[np.where(inside, k, 0)], np.uint64(absent)))
    return found


def _hits(w: np.ndarray, at: np.ndarray, lengths: list[int], table: np.ndarray | None, absent: int) -> list[np.ndarray]:
    """Columns of hits in order of place: place in ``w``, hash, span and words around."""
    place = _fingerprints(w, at)
    grams = windows(w, GRAM)[place]
    if table is not None:
        known = holds(table, grams)
        place, grams = place[known], grams[known]
    columns = [[place, grams, np.full(len(place), WINDOW), *_around(w, at, place, absent)]]
    for n in lengths:
        g = windows(w, n)
        first = np.arange(len(g))
        keep = first + n <= at[np.searchsorted(at, first, side="right").clip(max=len(at) - 1)]
        if table is not None:
            keep &= holds(table, g)
        first = first[keep]
        columns.append([first, g[keep], np.full(len(first), n), *[np.full(len(first), absent, np.uint64)] * 4])
    joined = [np.concatenate(c) for c in zip(*columns, strict=True)]
    order = np.argsort(joined[0], kind="stable")
    return [c[order] for c in joined]


def item_fingerprints(items: DataFrame) -> DataFrame:
    """(hash, span, words around, item_id) of test items (item_id, text), without repeats."""
    kind = items.schema["item_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = utf8(batch.column(1))
            w, at = words(raw, offsets, ALNUM)
            size = np.diff(at)
            place, *rest = _hits(w, at, [], None, 2)
            doc = np.searchsorted(at, place, side="right") - 1
            parts = [[doc, *rest]]
            for n in range(1, WINDOW):
                short = np.flatnonzero(size == n)
                g = windows(w, n)[at[short]] if len(short) else np.zeros(0, np.uint64)
                parts.append([short, g, np.full(len(short), n), *[np.full(len(short), 2, np.uint64)] * 4])
            doc, h, span, *around = (np.concatenate(c) for c in zip(*parts, strict=True))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(doc)),
                    pa.array(signed(h)),
                    pa.array(span.astype(np.int32)),
                    *[pa.array(signed(x)) for x in around],
                ],
                ["item_id", "hash", "span", "b1", "b2", "a1", "a2"],
            )

    schema = f"item_id {kind}, hash long, span int, b1 long, b2 long, a1 long, a2 long"
    return items.select("item_id", "text").mapInArrow(run, schema).distinct()


def find_contamination(transcripts: DataFrame, items: DataFrame) -> DataFrame:
    """Words of transcripts (media_id, text) that stand in a window of test items (item_id, text).

    -> media_id, n_words, n_hit, item_ids, hits: one row for each row. Words are
    runs of digits, letters a-z (A-Z in lower case) and characters beyond ASCII.
    A window is ten words of an item in a row, or the whole of an item of one to
    nine words; ``hits`` are the word ranges (from, to) found, ``n_hit`` the words
    inside any of them, ``item_ids`` the items with a window there. Null or empty
    texts have no words and no hits; empty items have no window; without items
    nothing is hit. Items with a null item_id count as one item, null among
    ``item_ids``. Rows with an equal media_id stay separate rows. Test items
    are not taken to be few: a table of fixed size keeps back transcript
    fingerprints that no item has, and the rest are joined.
    """
    prints = item_fingerprints(items)
    lengths = [r["span"] for r in prints.filter(F.col("span") < WINDOW).select("span").distinct().collect()]
    table = transcripts.sparkSession.sparkContext.broadcast(bit_table(prints, F.col("hash"), _TABLE_BITS))

    def work(columns):
        raw, offsets = utf8(columns["text"])
        n_words, text_key, counts, parts = [], [], [], []
        for i, j in slices(offsets):
            w, at = words(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], ALNUM)
            place, *rest = _hits(w, at, lengths, table.value, 1)
            doc = np.searchsorted(at, place, side="right") - 1
            n_words.append(np.diff(at))
            sums = np.zeros(len(w) + 1, np.uint64)
            np.cumsum(mix(w + np.arange(len(w), dtype=np.uint64)), out=sums[1:])
            text_key.append(sums[at[1:]] - sums[at[:-1]])
            counts.append(np.bincount(doc, minlength=j - i))
            parts.append([rest[0], place - at[doc], *rest[1:]])
        total = np.concatenate(counts) if counts else np.zeros(0, np.int64)
        starts = np.concatenate(([0], np.cumsum(total))).astype(np.int32)
        merged = [np.concatenate(c) for c in zip(*parts, strict=True)] if parts else [np.zeros(0, np.uint64)] * 7
        arrays = [
            pa.array(c.astype(np.int32)) if name in ("at", "span") else pa.array(signed(c.astype(np.uint64)))
            for name, c in zip(_FIELDS, merged, strict=True)
        ]
        return {
            "n_words": pa.array(np.concatenate(n_words) if n_words else [], pa.int64()),
            "text_key": pa.array(signed(np.concatenate(text_key)) if text_key else [], pa.int64()),
            "found": pa.ListArray.from_arrays(pa.array(starts), pa.StructArray.from_arrays(arrays, _FIELDS)),
        }

    rows = add_columns(
        transcripts, ["text"], ["media_id"], f"n_words long, text_key long, found array<{_HIT}>", work
    )
    # first an entry of the row itself, which meets no fingerprint: it keeps rows without hits, and counts equal rows
    key = F.xxhash64("media_id", "n_words", "text_key")
    own = F.array(F.struct(key, F.lit(0), F.lit(0), *[F.lit(1).cast("long")] * 4).cast(_HIT))
    rows = rows.select("media_id", "n_words", "text_key", F.explode(F.concat(own, "found")).alias("f"))
    rows = rows.select("media_id", "n_words", "text_key", "f.*")
    tests = prints.select("hash", "span", "item_id", F.lit(True).alias("known"), *[F.col(c).alias(f"i_{c}") for c in ("b1", "b2", "a1", "a2")])
    rows = rows.join(tests, ["hash", "span"], "left")

    def reach(first, second):
        one, two = F.col(first) == F.col(f"i_{first}"), F.col(second) == F.col(f"i_{second}")
        return F.when(one & two, 2).when(one, 1).otherwise(0)

    back, on = reach("b1", "b2"), reach("a1", "a2")
    full = F.col("span") == WINDOW
    found = F.col("known") & (~full | (back + on >= _REACH))
    low = F.when(full, F.col("at") - back).otherwise(F.col("at"))
    high = F.when(full, F.col("at") + GRAM + on).otherwise(F.col("at") + F.col("span"))
    rows = rows.groupBy("media_id", "n_words", "text_key").agg(
        F.sum(F.when(F.col("span") == 0, 1)).alias("copies"),
        F.collect_set(F.when(found, F.struct(low.alias("from"), high.alias("to")))).alias("hits"),
        F.collect_set(F.when(found, F.struct("item_id"))).alias("items"),
    )
    inside = F.array_distinct(F.flatten(F.transform("hits", lambda h: F.sequence(h["from"], h["to"] - 1))))
    return rows.select(
        "media_id",
        "n_words",
        F.size(inside).cast("long").alias("n_hit"),
        F.transform("items", lambda x: x["item_id"]).alias("item_ids"),
        F.array_sort("hits").alias("hits"),
        F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("_copy"),
    ).drop("_copy")
