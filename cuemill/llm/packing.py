"""Best-fit packing of transcripts into training sequences by a grouping genetic algorithm.

Transcripts become pieces of at most a sequence's length. Pieces are dealt into
blocks of bounded size. On every block a few islands work, each a row of its own
with a population of packings; a packing is a list of sequences, and these are
what is inherited: a child takes whole well-filled sequences of one parent,
loses the sequences of the other that hold any of the same pieces, and the
pieces thereby displaced are placed best-fit. Between epochs the best packing
of an island migrates to the next island of its block. Then the block's best
packing is taken; the pieces of its loosely filled sequences go on to fewer,
mixed blocks, until one block is left.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cuemill.llm.batches import add_columns
from cuemill.llm.stored import stored
from cuemill.llm.tokens import Vocabulary

# Pieces of a block on average; islands of a block, epochs, and what an island does in one.
BLOCK = 2048
ISLANDS, EPOCHS = 2, 2
POPULATION, GENERATIONS = 6, 30
# Shares of a parent's sequences: those that may be injected, those that are, and those a mutation empties.
WELL_FILLED, INJECTED, EMPTIED = 0.6, 0.3, 0.05
# A sequence with more than this share free is loose; at most this share of a block's pieces goes on.
LOOSE, ONWARD = 0.01, 1 / 8
_PIECE = "struct<start: bigint, length: int, ids_crc32: bigint>"

Packing = tuple[np.ndarray, np.ndarray]  # sequence of every piece, free places of every sequence


def cut_pieces(n: int, capacity: int) -> np.ndarray:
    """Ends of the pieces of ``n`` tokens: all but the first are whole sequences."""
    return np.arange((n - 1) % capacity + 1, n + 1, capacity)


def transcript_pieces(transcripts: DataFrame, vocabulary: Vocabulary, capacity: int, end_id: int) -> DataFrame:
    """(media_id, piece, start, length, ids_crc32) of transcripts (media_id, text), in one pass."""
    shared = transcripts.sparkSession.sparkContext.broadcast(vocabulary)

    def work(columns):
        start, length, crc, count = [], [], [], []
        for text in columns["text"].to_pylist():
            ids = np.append(shared.value.ids(text or ""), end_id).astype("<u4")
            ends = cut_pieces(len(ids), capacity)
            begins = np.concatenate(([0], ends[:-1]))
            start.append(begins)
            length.append(ends - begins)
            crc += [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(begins.tolist(), ends.tolist(), strict=True)]
            count.append(len(ends))
        at = np.concatenate(([0], np.cumsum(count))).astype(np.int32)
        fields = [pa.array(np.concatenate(start), pa.int64()), pa.array(np.concatenate(length).astype(np.int32)), pa.array(crc, pa.int64())]
        values = pa.StructArray.from_arrays(fields, ["start", "length", "ids_crc32"])
        return {"pieces": pa.ListArray.from_arrays(pa.array(at), values)}

    rows = add_columns(transcripts, ["text"], ["media_id"], f"pieces array<{_PIECE}>", work)
    return rows.select("media_id", F.posexplode("pieces").alias("piece", "p")).select("media_id", "piece", "p.*")


def _best_fit(pieces: np.ndarray, sizes: np.ndarray, free: list[int], sequence: np.ndarray, capacity: int) -> np.ndarray:
    """Place ``pieces`` in this order, each where least remains free; ``free`` and ``sequence`` are completed."""
    by_free: list[list[int]] = [[] for _ in range(capacity + 1)]
    some = 0  # bit f: a sequence with f free places exists
    for k, f in enumerate(free):
        if f:
            by_free[f].append(k)
            some |= 1 << f
    for piece, size in zip(pieces.tolist(), sizes[pieces].tolist(), strict=True):
        fitting = some >> size
        if fitting:
            f = size + (fitting & -fitting).bit_length() - 1
            k = by_free[f].pop()
            if not by_free[f]:
                some ^= 1 << f
        else:
            f, k = capacity, len(free)
            free.append(capacity)
        free[k] = f = f - size
        if f:
            by_free[f].append(k)
            some |= 1 << f
        sequence[piece] = k
    return np.array(free, np.int64)


def new_packing(sizes: np.ndarray, order: np.ndarray, capacity: int) -> Packing:
    """Best fit in the order given."""
    sequence = np.zeros(len(sizes), np.int32)
    return sequence, _best_fit(order, sizes, [], sequence, capacity)


def cross(sizes: np.ndarray, one: Packing, other: Packing, capacity: int, rng: np.random.Generator) -> Packing:
    """``one`` with well-filled sequences of ``other`` in place of those that hold their pieces."""
    (seq, free), (seq2, free2) = one, other
    n = len(free2)
    fullest = np.argsort(free2 + rng.random(n), kind="stable")[: max(1, int(n * WELL_FILLED))]
    taken = np.sort(rng.choice(fullest, min(len(fullest), max(1, int(n * INJECTED))), replace=False))
    number = np.full(n, -1)
    number[taken] = np.arange(len(taken))
    injected = number[seq2] >= 0
    stays = np.ones(len(free), bool)
    stays[seq[injected]] = False
    kept = np.flatnonzero(stays)
    renumbered = np.full(len(free), -1)
    renumbered[kept] = len(taken) + np.arange(len(kept))
    child = np.where(injected, number[seq2], renumbered[seq]).astype(np.int32)
    # sizes fall with the piece's number, so displaced pieces come largest first
    displaced = np.flatnonzero(child < 0)
    return child, _best_fit(displaced, sizes, np.concatenate((free2[taken], free[kept])).tolist(), child, capacity)


def mutate(sizes: np.ndarray, packing: Packing, capacity: int, rng: np.random.Generator) -> Packing:
    """The emptiest sequences and some others dissolved, their pieces placed best-fit."""
    seq, free = packing
    n = max(2, int(len(free) * EMPTIED))
    stays = np.ones(len(free), bool)
    stays[np.argsort(-free, kind="stable")[:n]] = False
    stays[rng.integers(0, len(free), n)] = False
    kept = np.flatnonzero(stays)
    renumbered = np.full(len(free), -1)
    renumbered[kept] = np.arange(len(kept))
    child = renumbered[seq].astype(np.int32)
    return child, _best_fit(np.flatnonzero(child < 0), sizes, free[kept].tolist(), child, capacity)


def rank_of(packing: Packing) -> tuple[int, int]:
    """Smaller is better: number of sequences, then the less evenly the free places are spread."""
    return len(packing[1]), -int((packing[1].astype(np.int64) ** 2).sum())


def evolve(sizes: np.ndarray, elites: list[Packing], capacity: int, seed: list[int]) -> list[Packing]:
    """The two best packings after an epoch, or as soon as none can use fewer sequences. ``sizes`` fall."""
    rng = np.random.default_rng(seed)
    least = -(-int(sizes.sum()) // capacity)
    group = sorted(elites, key=rank_of)
    while len(group) < POPULATION:
        group.append(new_packing(sizes, rng.permutation(len(sizes)), capacity))
    group.sort(key=rank_of)
    for _ in range(GENERATIONS):
        if len(group[0][1]) <= least:
            break
        a, b = rng.choice(min(4, len(group)), 2, replace=False)
        child = cross(sizes, group[a], group[b], capacity, rng)
        if rng.random() < 0.5:
            child = mutate(sizes, child, capacity, rng)
        group[-1] = child
        group.sort(key=rank_of)
    return group[:2]


def _free(sizes: np.ndarray, sequence: np.ndarray, capacity: int) -> np.ndarray:
    return capacity - np.bincount(sequence, weights=sizes).astype(np.int64)


def _epoch(islands: DataFrame, number: int, capacity: int) -> DataFrame:
    """Islands (block, island, sizes, elites) after an epoch, with the number of sequences of their best packing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                block, island = (row.column(k)[0].as_py() for k in (0, 1))
                sizes = row.column(2).flatten().to_numpy().astype(np.int64)
                sent = [np.frombuffer(e, np.int32) for e in row.column(3)[0].as_py()]
                elites = [(s, _free(sizes, s, capacity)) for s in sent]
                best = evolve(sizes, elites, capacity, [block, island, number])
                kept = pa.array([[s.astype(np.int32).tobytes() for s, _ in best]], pa.list_(pa.binary()))
                score = [pa.array([int(x)]) for x in rank_of(best[0])]
                yield pa.RecordBatch.from_arrays(
                    [*(row.column(k) for k in range(3)), kept, *score], ["block", "island", "sizes", "elites", "used", "uneven"]
                )

    schema = "block long, island int, sizes array<int>, elites array<binary>, used long, uneven long"
    return islands.mapInArrow(run, schema)


def _migrated(islands: DataFrame, tasks: int) -> DataFrame:
    """Every island with its own elites and the best packing of the island before it."""
    own = F.struct("island", "sizes", "elites")
    sent = F.struct(
        ((F.col("island") + 1) % ISLANDS).cast("int").alias("island"),
        F.lit(None).cast("array<int>").alias("sizes"),
        F.slice("elites", 1, 1).alias("elites"),
    )
    rows = islands.select("block", F.explode(F.array(own, sent)).alias("r")).select("block", "r.*")
    rows = rows.repartition(tasks, "block", "island").groupBy("block", "island")
    return rows.agg(F.first("sizes", ignorenulls=True).alias("sizes"), F.flatten(F.collect_list("elites")).alias("elites"))


def _evolved(pieces: DataFrame, blocks: int, capacity: int) -> DataFrame:
    """(block, packing) of pieces (block, length): the best packing any island of the block found."""
    parallel = pieces.sparkSession.sparkContext.defaultParallelism
    tasks = min(blocks * ISLANDS, max(2 * parallel, blocks * ISLANDS // 8))
    sizes = pieces.groupBy("block").agg(F.sort_array(F.collect_list("length"), asc=False).alias("sizes"))
    islands = sizes.select(
        "block",
        F.explode(F.array(*[F.lit(k) for k in range(ISLANDS)])).alias("island"),
        "sizes",
        F.array().cast("array<binary>").alias("elites"),
    ).repartition(tasks, "block", "island")
    for number in range(EPOCHS):
        if number:
            islands = _migrated(islands, tasks)
        islands = _epoch(islands.select("block", "island", "sizes", "elites"), number, capacity)
    best = F.min_by(F.element_at("elites", 1), F.struct("used", "uneven", "island"))
    return islands.groupBy("block").agg(best.alias("packing"))


def _assigned(pieces: DataFrame, best: DataFrame, level: int, last: bool, capacity: int) -> DataFrame:
    """Pieces with sequence_id and offset; null for pieces of loose sequences that go on."""
    columns = [c for c in pieces.columns if c != "block"]
    schema = StructType([pieces.schema[c] for c in columns]).add("sequence_id", "long").add("offset", "long")

    def assign(left: pa.Table, right: pa.Table) -> pa.Table:
        length = left.column("length").to_numpy().astype(np.int64)
        order = np.argsort(-length, kind="stable")
        sequence = np.frombuffer(right.column("packing")[0].as_py(), np.int32)
        sizes = length[order]
        free = _free(sizes, sequence, capacity)
        goes_on = np.zeros(len(free), bool)
        if not last:
            emptiest = np.argsort(-free, kind="stable")
            emptiest = emptiest[free[emptiest] > LOOSE * capacity]
            held = np.cumsum(np.bincount(sequence, minlength=len(free))[emptiest])
            goes_on[emptiest[held <= len(length) * ONWARD]] = True
        by = np.argsort(sequence, kind="stable")
        ends = np.cumsum(sizes[by])
        first = np.concatenate(([True], np.diff(sequence[by]) > 0))
        begins = ends - sizes[by]
        offset = begins - np.maximum.accumulate(np.where(first, begins, 0))
        block = left.column("block")[0].as_py()
        number = (level << 56) + (block << 20) + sequence[by].astype(np.int64)
        off = goes_on[sequence[by]]
        return left.take(pa.array(order[by])).select(columns).append_column(
            "sequence_id", pa.array(number, mask=off)
        ).append_column("offset", pa.array(offset, mask=off))

    return pieces.groupBy("block").cogroup(best.groupBy("block")).applyInArrow(assign, schema)


def pack_transcripts(transcripts: DataFrame, vocabulary: Vocabulary, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """Every transcript (media_id, text) as token pieces, placed in as few sequences of ``capacity`` tokens as found.

    -> media_id, piece, start, length, ids_crc32, sequence_id, offset. A
    transcript's tokens are the ids of its whole text and then ``end_id``; a null
    or empty text is that one token. More than ``capacity`` tokens are cut so that
    all pieces but the first fill a sequence; ``start`` counts the tokens before
    the piece. ``offset`` is its place in the sequence, where pieces stand without
    gaps; ``ids_crc32`` is taken over its ids as little-endian unsigned 32-bit
    numbers. Equal rows are packed each. No rows give no rows; other columns are
    not looked at. Which of equally long pieces of a block goes where is open.
    """
    pieces = transcript_pieces(transcripts, vocabulary, capacity, end_id)
    pieces = stored(pieces.withColumn("salt", F.xxhash64(F.monotonically_increasing_id())))
    done, level = [], 0
    while True:
        blocks = math.ceil(pieces.count() / BLOCK)
        dealt = pieces.withColumn("block", F.pmod(F.xxhash64(F.lit(level), "salt"), F.lit(max(blocks, 1))))
        packed = _assigned(dealt, _evolved(dealt, max(blocks, 1), capacity), level, blocks <= 1, capacity)
        packed = stored(packed)
        done.append(packed.filter("sequence_id is not null"))
        if blocks <= 1:
            break
        pieces = packed.filter("sequence_id is null").drop("sequence_id", "offset")
        level += 1
    found = done[0]
    for rows in done[1:]:
        found = found.union(rows)
    return found.drop("salt")
