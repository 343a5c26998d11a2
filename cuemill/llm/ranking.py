"""Ranked lexical search over transcripts through FP-trees of their term vectors.

A transcript is restricted to the terms that the cues ask for, the most frequent
ones first. Of every block of transcripts a tree is made: those whose vectors
begin alike share a path. A node knows, over all transcripts below it, the
largest count of every term and the smallest length factor, which bound every
score there. One walk, depth first, enters a node with the cues whose bound
reaches their k-th best score so far; transcripts of a leaf are scored exactly.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cuemill.llm.batches import add_columns, slices, utf8
from cuemill.llm.stored import stored
from cuemill.llm.words import ALNUM, words

# Text of the cues that are looked for in one pass, in bytes on average, and numbers of their matrix at most.
CUE_BYTES, CELLS = 1 << 18, 1 << 21
# Transcripts and vector entries of a tree, and transcripts of a leaf.
BLOCK, ENTRIES, LEAF = 8192, 1 << 20, 16
# Fixed values of the score: its scale, and how much a term's count and a transcript's length weigh.
SCALE, COUNTED, LENGTH, SHARE = 1_000_000_000, 1000, 12, 25


@dataclass
class Asked:
    """Cues of one pass: their vocabulary, and groups of them with a matrix of how often they hold each term."""

    terms: np.ndarray  # sorted fingerprints
    groups: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)  # cues, terms, matrix


def asked_terms(texts: list[str | None]) -> Asked:
    raw, offsets = utf8(pa.array(texts, pa.string()))
    w, at = words(raw, offsets, ALNUM)
    terms, of = np.unique(w, return_inverse=True)
    asked, k = Asked(terms), 0
    while k < len(texts):
        n, used = k, np.zeros(0, np.int64)
        while n < len(texts):
            more = np.union1d(used, of[at[n] : at[n + 1]])
            if n > k and len(more) * (n + 1 - k) > CELLS:
                break
            n, used = n + 1, more
        counts = np.zeros((n - k, len(used)), np.int64)
        row = np.repeat(np.arange(n - k), np.diff(at[k : n + 1]))
        np.add.at(counts, (row, np.searchsorted(used, of[at[k] : at[n]])), 1)
        asked.groups.append((np.arange(k, n), used, counts))
        k = n
    return asked


def term_vectors(transcripts: DataFrame, terms: np.ndarray) -> DataFrame:
    """(media_id, n_terms, term, tf): every transcript's length in terms, and those of ``terms`` it holds, by place."""
    shared = transcripts.sparkSession.sparkContext.broadcast(terms)

    def work(columns):
        raw, offsets = utf8(columns["text"])
        known = shared.value
        sizes, count, term, tf = [], [], [], []
        for i, j in slices(offsets):
            w, at = words(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], ALNUM)
            sizes.append(np.diff(at))
            place = np.minimum(np.searchsorted(known, w), max(len(known) - 1, 0))
            held = known[place] == w if len(known) else np.zeros(len(w), bool)
            doc = np.repeat(np.arange(j - i), sizes[-1])[held]
            both, times = np.unique(doc * len(known) + place[held], return_counts=True)
            count.append(np.bincount(both // max(len(known), 1), minlength=j - i))
            term.append(both % max(len(known), 1))
            tf.append(times)
        if not sizes:
            sizes, count, term, tf = ([np.zeros(0, np.int64)] for _ in range(4))
        ends = pa.array(np.concatenate(([0], np.cumsum(np.concatenate(count)))).astype(np.int32))
        return {
            "n_terms": pa.array(np.concatenate(sizes), pa.int64()),
            "term": pa.ListArray.from_arrays(ends, pa.array(np.concatenate(term), pa.int32())),
            "tf": pa.ListArray.from_arrays(ends, pa.array(np.concatenate(tf), pa.int64())),
        }

    return add_columns(transcripts, ["text"], ["media_id"], "n_terms long, term array<int>, tf array<long>", work)


def _document_counts(vectors: DataFrame, terms: int) -> np.ndarray:
    """Transcripts that hold each term; one number a term reaches the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(terms, np.int64)
        for batch in batches:
            total += np.bincount(batch.column(0).flatten().to_numpy(), minlength=terms)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array(total[held])], ["term", "df"])

    rows = vectors.select("term").mapInArrow(count, "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).toArrow()
    found = np.zeros(terms, np.int64)
    found[rows.column("term").to_numpy()] = rows.column("df").to_numpy()
    return found


def parts_of(weight, tf, m):
    """What a term adds to a score."""
    return weight * ((SCALE * tf) // (COUNTED * tf + LENGTH * m))


class Tree:
    """FP-tree of a block: transcripts in the order of their vectors, and nodes, parents before their children."""

    def __init__(self, term: np.ndarray, tf: np.ndarray, at: np.ndarray, m: np.ndarray, terms: int):
        """``term`` are frequency ranks, rising in each transcript; transcript d has entries at[d] to at[d + 1]."""
        big = term.astype(">u4").tobytes()
        keys = [big[4 * a : 4 * b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        self.order = np.array(sorted(range(len(keys)), key=keys.__getitem__), np.int64)
        size = np.diff(at)[self.order]
        self.at = np.concatenate(([0], np.cumsum(size)))
        place = np.repeat(at[:-1][self.order] - self.at[:-1], size) + np.arange(self.at[-1])
        self.term, self.tf, self.m, self.size = term[place], tf[place], m[self.order], size
        self.low: list[int] = []
        self.high: list[int] = []
        self.children: list[list[int]] = []
        self._split()
        self._summarise(terms)

    def _node(self, low: int, high: int) -> int:
        self.low.append(low)
        self.high.append(high)
        self.children.append([])
        return len(self.low) - 1

    def _split(self) -> None:
        open_nodes = [(self._node(0, len(self.size)), 0)]
        while open_nodes:
            node, depth = open_nodes.pop()
            low, high = self.low[node], self.high[node]
            if high - low <= LEAF:
                continue
            # one path as long as the first and last transcript agree: all between them do, too
            while self.size[low] > depth and self.term[self.at[low] + depth] == self.term[self.at[high - 1] + depth]:
                depth += 1
            # those that end here come first
            ended = low + int(np.searchsorted(self.size[low:high] > depth, True))
            here = self.term[self.at[ended:high] + depth] if ended < high else np.zeros(0, np.int64)
            bounds = [low, *range(low + LEAF, ended, LEAF), ended] if ended > low else [low]
            bounds += (ended + 1 + np.flatnonzero(np.diff(here))).tolist() + [high] * (ended < high)
            start = bounds[0]
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                if b - start > LEAF:
                    if a > start:
                        self.children[node].append(self._node(start, a))
                    start = a
                if b - a > LEAF:
                    self.children[node].append(child := self._node(a, b))
                    open_nodes.append((child, depth + 1))
                    start = b
            if start < high:
                self.children[node].append(self._node(start, high))

    def _summarise(self, terms: int) -> None:
        """Largest counts and smallest length factors below every node."""
        n = len(self.low)
        self.most = np.zeros((n, terms), np.int64)
        self.least_m = np.zeros(n, np.int64)
        leaves = np.array([k for k in range(n) if not self.children[k]], np.int64)
        by_place = leaves[np.argsort(np.array(self.low)[leaves], kind="stable")]
        lows = np.array(self.low)[by_place]
        leaf = by_place[np.searchsorted(lows, np.repeat(np.arange(len(self.size)), self.size), side="right") - 1]
        np.maximum.at(self.most, (leaf, self.term), self.tf)
        self.least_m[by_place] = np.minimum.reduceat(self.m, lows)
        for k in range(n - 1, -1, -1):
            if self.children[k]:
                self.most[k] = self.most[self.children[k]].max(axis=0)
                self.least_m[k] = self.least_m[self.children[k]].min()

    def search(self, weight: np.ndarray, counts: np.ndarray, best: np.ndarray) -> list[tuple[np.ndarray, ...]]:
        """(cue, transcript of the block, score) of all that reach the cue's k-th best score.

        ``weight`` by frequency rank, ``counts`` of the terms of each cue; ``best``,
        each cue's k best scores so far in rising order, is kept up to date.
        """
        kind = counts.dtype
        bound = parts_of(weight, self.most, self.least_m[:, None]).astype(kind) @ counts.T
        found = []
        walk = [(0, np.arange(len(counts)))]
        while walk:
            node, cues = walk.pop()
            cues = cues[bound[node, cues] >= np.maximum(best[cues, 0], 1)]
            if not len(cues):
                continue
            if self.children[node]:
                # the last one put down is the next: the most promising child
                promising = bound[np.ix_(self.children[node], cues)].sum(axis=1)
                walk += [(self.children[node][k], cues) for k in np.argsort(promising, kind="stable")]
                continue
            low, high = self.low[node], self.high[node]
            a, b = self.at[low], self.at[high]
            held, column = np.unique(self.term[a:b], return_inverse=True)
            row = np.repeat(np.arange(high - low), self.size[low:high])
            exact = np.zeros((high - low, len(held)), kind)
            exact[row, column] = parts_of(weight[self.term[a:b]], self.tf[a:b], self.m[low:high][row])
            scores = (counts[np.ix_(cues, held)] @ exact.T).astype(np.int64)
            hit = scores >= np.maximum(best[cues, 0], 1)[:, None]
            better = np.flatnonzero(hit.any(axis=1))
            if len(better):
                c, d = np.nonzero(hit[better])
                found.append((cues[better][c], self.order[low + d], scores[better][c, d]))
                both = np.concatenate((best[cues[better]], scores[better]), axis=1)
                best[cues[better]] = np.partition(both, both.shape[1] - best.shape[1], axis=1)[:, -best.shape[1] :]
                best[cues[better]] = np.sort(best[cues[better]], axis=1)
        return found


def _ranked_block(batch: pa.RecordBatch, model: dict, best: list[np.ndarray], k: int) -> Iterator[pa.RecordBatch]:
    """(cue, media_id, score): the k best of the block for each cue, so far as they reach its k-th best score."""
    ids, n_terms, term, tf = batch.columns
    at = np.concatenate(([0], np.cumsum(term.value_lengths().to_numpy())))
    doc = np.repeat(np.arange(len(ids)), np.diff(at))
    rank, tf = model["rank"][term.flatten().to_numpy()], tf.flatten().to_numpy()
    order = np.lexsort((rank, doc))
    # the block's own terms, still in the order of their frequency
    own, local = np.unique(rank[order], return_inverse=True)
    m = 100 - SHARE + (SHARE * n_terms.to_numpy() * model["N"]) // max(model["L"], 1)
    tree = Tree(local, tf[order], at, m, len(own))
    id_rank = np.empty(len(ids), np.int64)
    id_rank[pc.sort_indices(ids, null_placement="at_start").to_numpy()] = np.arange(len(ids))
    for (cues, used, counts), top in zip(model["groups"], best, strict=True):
        place = np.searchsorted(own, used)
        here = (place < len(own)) & (own[np.minimum(place, len(own) - 1)] == used) if len(own) else np.zeros(len(used), bool)
        asked = np.zeros((len(cues), len(own)), counts.dtype)
        asked[:, place[here]] = counts[:, here]
        found = tree.search(model["weight"][own], asked, top)
        if not found:
            continue
        cue, doc, score = (np.concatenate(x) for x in zip(*found, strict=True))
        keep = score >= top[cue, 0]
        cue, doc, score = cue[keep], doc[keep], score[keep]
        by = np.lexsort((id_rank[doc], -score, cue))
        cue, doc, score = cue[by], doc[by], score[by]
        nth = np.arange(len(cue)) - np.searchsorted(cue, cue)
        cue, doc, score = cue[nth < k], doc[nth < k], score[nth < k]
        yield pa.RecordBatch.from_arrays(
            [pa.array(cues[cue], pa.int32()), ids.take(pa.array(doc)), pa.array(score)], ["cue", "media_id", "score"]
        )


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows together as far as a tree may hold them, one row at least."""
    held: list[pa.RecordBatch] = []
    rows = entries = 0
    for batch in batches:
        sizes = np.concatenate(([0], np.cumsum(batch.column(2).value_lengths().to_numpy())))
        i = 0
        while i < batch.num_rows:
            j = min(int(np.searchsorted(sizes, sizes[i] + ENTRIES - entries, side="right")) - 1, i + BLOCK - rows)
            if j <= i and not held:
                j = i + 1
            if j > i:
                held.append(batch.slice(i, j - i))
                rows, entries = rows + j - i, entries + int(sizes[j] - sizes[i])
            if j < batch.num_rows:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, rows, entries = [], 0, 0
            i = max(i, j)
    if rows:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _ranked(transcripts: DataFrame, cues: DataFrame, k: int) -> DataFrame:
    """Results of cues (cue_idx, text) that fit one pass."""
    spark = transcripts.sparkSession
    rows = cues.select("cue_idx", "text").collect()
    asked = asked_terms([r["text"] for r in rows])
    vectors = stored(term_vectors(transcripts, asked.terms))
    total = vectors.agg(F.count_if(F.col("n_terms") > 0).alias("N"), F.sum("n_terms").alias("L")).first()
    df = _document_counts(vectors, len(asked.terms))
    n = total["N"] or 0
    by_frequency = np.argsort(-df, kind="stable")
    rank = np.empty(len(df), np.int64)
    rank[by_frequency] = np.arange(len(df))
    weight = [math.floor(1000 * math.log((2 * n + 2) / (2 * d + 1))) for d in df[by_frequency].tolist()]
    weight = np.array(weight, np.int64)
    groups = []
    for of, used, counts in asked.groups:
        # floating point is exact as long as no score can pass 2^53
        safe = int((counts @ np.maximum(weight[rank[used]], 1)).max(initial=0)) * (SCALE // COUNTED) < 2**53
        by = np.argsort(rank[used])
        groups.append((of, rank[used][by], counts[:, by].astype(np.float64 if safe else np.int64)))
    model = {"rank": rank, "weight": weight, "N": n, "L": total["L"] or 0, "groups": groups}
    shared = spark.sparkContext.broadcast(model)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [np.zeros((len(of), k), np.int64) for of, _, _ in shared.value["groups"]]
        for block in _blocks(batches):
            yield from _ranked_block(block, shared.value, best, k)

    schema = StructType().add("cue", "integer").add(transcripts.schema["media_id"]).add("score", "long")
    found = vectors.filter("size(term) > 0").mapInArrow(search, schema)
    order = Window.partitionBy("cue").orderBy(F.desc("score"), F.asc_nulls_first("media_id"))
    found = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    kind = cues.schema["cue_idx"]
    names = spark.createDataFrame([(i, r["cue_idx"]) for i, r in enumerate(rows)], StructType().add("cue", "integer").add(kind))
    return found.join(F.broadcast(names), "cue").select("cue_idx", "rank", "media_id", "score")


def rank_transcripts(transcripts: DataFrame, cues: DataFrame, k: int = 20) -> DataFrame:
    """The ``k`` transcripts (media_id, text) that score highest for each cue (cue_idx, text).

    -> cue_idx, rank, media_id, score: which transcripts a cue may come from.
    Terms are runs of digits, letters a-z (A-Z in lower case) and characters
    beyond ASCII. With N transcripts that have a term, L terms in all, df
    transcripts that hold a term, n terms in a transcript and m = 75 + (25 n N) div L,
    a term that it holds tf times adds floor(1000 ln((2N + 2) / (2df + 1))) *
    ((10^9 tf) div (1000 tf + 12 m)) for each time it stands in the cue. Ranks count
    from 1 by score and then by media_id, null first; scores of 0 are left out, so
    a cue without a term, or none that occurs, has no rows. Null texts have no
    terms. Rows with equal media_id or cue_idx are rows of their own. Cues are
    looked for in passes of bounded size; other columns are not looked at. Terms
    are compared by 64-bit fingerprints.
    """
    size = cues.agg(F.sum(F.octet_length("text") + 1).alias("n")).first()["n"] or 0
    passes = math.ceil(size / CUE_BYTES) or 1
    found = None
    for number in range(passes):
        mine = cues.filter(F.pmod(F.xxhash64("text", "cue_idx"), F.lit(passes)) == number)
        ranked = _ranked(transcripts, mine, k)
        found = ranked if found is None else found.union(ranked)
    return found
