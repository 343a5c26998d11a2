"""Nearest vectors by multi-index hashing of learned binary codes.

Vectors get a last component that makes all lengths equal, so that the largest
inner product is the smallest angle, and are turned by learned rotations whose
signs are the code. Codes are cut into substrings, each with its own table from
value to rows. If two codes differ in at most r bits, one of m substrings
differs in at most a = floor(r / m) bits, and more exactly one of the first
r - a m + 1 in a or one of the others in a - 1. Probing all values that near in
each table returns every code within r. Those that are within r are ranked by
their inner products in double precision. How large r must be is measured: a few
queries are compared with every row, and r reaches as far as their true
neighbours' codes lie, however many rows there are.

Rows lie in blocks of bounded size. A block's tables are made once, in the task
that has its rows, and all queries, far fewer than the rows, pass by them in
batches.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cuemill.llm.sampling import bounded, draw

_WORD = 12  # bits of a substring
# Rows of a block.
ROWS = 16_384
# Queries that are compared with every row to measure how far codes of true neighbours lie.
MEASURED = 128


@dataclass
class CodeModel:
    """Rotations (dim + 1, bits), the length all vectors are brought to, and how codes of the sample spread."""

    dim: int
    length: float
    rotation: np.ndarray
    sample: np.ndarray  # codes of the sample

    def codes(self, vectors: np.ndarray, stored: bool) -> np.ndarray:
        """Packed codes; a stored vector gets the last component, a query has 0 there."""
        last = np.zeros(len(vectors))
        if stored:
            last = np.sqrt(np.maximum(self.length**2 - (vectors**2).sum(axis=1), 0))
        signs = np.column_stack([vectors, last]) @ self.rotation > 0
        return np.packbits(signs, axis=1)


def learn_codes(vectors: DataFrame, bits: int = 256, sample_rows: int = 4_096, rounds: int = 20) -> CodeModel | None:
    """Rotations from a bounded sample of (vec_id, embedding); None if there is no vector.

    Every rotation starts at random and is then turned, ``rounds`` times, to
    where the signs of the sample lose least (iterative quantisation). The
    longest length is taken over all rows.
    """
    square = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    row = vectors.agg(F.max(square).alias("m"), F.max(F.size("embedding")).alias("dim")).first()
    if row["m"] is None:
        return None
    sample = bounded(vectors.select(F.col("vec_id").alias("media_id"), "embedding"), sample_rows)
    table = sample.select("media_id", "embedding").toArrow().sort_by([("media_id", "ascending")])
    x = np.array(table.column("embedding").to_pylist(), float).reshape(-1, row["dim"])
    length = float(np.sqrt(row["m"]))
    full = np.column_stack([x, np.sqrt(np.maximum(length**2 - (x**2).sum(axis=1), 0))])
    dim = full.shape[1]
    random = np.random.default_rng(3)
    parts = []
    while sum(p.shape[1] for p in parts) < bits:
        turn = np.linalg.qr(random.normal(size=(dim, dim)))[0]
        for _ in range(rounds):
            u, _, v = np.linalg.svd(full.T @ np.sign(full @ turn))
            turn = u @ v
        parts.append(turn)
    model = CodeModel(row["dim"], length, np.column_stack(parts)[:, :bits], np.zeros((0, bits // 8), np.uint8))
    model.sample = model.codes(x, True)
    return model


def _words(codes: np.ndarray) -> np.ndarray:
    """Substrings of packed codes, the last one filled up with zeros."""
    bits = np.unpackbits(codes, axis=1)
    bits = np.pad(bits, ((0, 0), (0, -bits.shape[1] % _WORD)))
    return bits.reshape(len(codes), -1, _WORD) @ (1 << np.arange(_WORD))


@lru_cache(maxsize=32)
def _near(radius: int) -> np.ndarray:
    """All substring values with at most ``radius`` bits set."""
    values = np.arange(1 << _WORD)
    return values[np.bitwise_count(values) <= radius] if radius >= 0 else values[:0]


class MultiIndex:
    """One table per substring: rows in order of its value, and where each value begins."""

    def __init__(self, codes: np.ndarray):
        self.codes = np.ascontiguousarray(codes)
        self.rows, self.first = [], []
        for column in _words(codes).T:
            order = np.argsort(column, kind="stable")
            self.rows.append(order)
            self.first.append(np.searchsorted(column[order], np.arange((1 << _WORD) + 1)))

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Every row whose code differs from ``code`` in at most ``radius`` bits."""
        m, n = len(self.rows), len(self.codes)
        radius = min(radius, 8 * self.codes.shape[1])
        most, extra = divmod(radius, m)
        seen = np.zeros(n, bool)
        for k, value in enumerate(_words(code[None])[0]):
            probes = value ^ _near(most if k <= extra else most - 1)
            low = self.first[k][probes]
            size = self.first[k][probes + 1] - low
            hit = size > 0
            low, size = low[hit], size[hit]
            if len(low):
                at = np.repeat(low - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum())
                seen[self.rows[k][at]] = True
        rows = np.flatnonzero(seen)
        apart = np.bitwise_count(self.codes[rows] ^ code).sum(axis=1)
        return rows[apart <= radius]


def _spread(codes: np.ndarray, model: CodeModel) -> tuple[np.ndarray, np.ndarray]:
    """Mean and standard deviation, 1 at least, of every code's distances to the sample."""
    apart = [np.bitwise_count(model.sample ^ code).sum(axis=1) for code in codes]
    return np.array([a.mean() for a in apart]), np.array([max(a.std(), 1.0) for a in apart])


def _radii(codes: np.ndarray, model: CodeModel, rows: int, wanted: int, reach: float | None = None) -> np.ndarray:
    """Per query a radius within which about ``wanted`` of ``rows`` codes lie, from the distances to the sample.

    The tail below the sample's finest share is that of a normal distribution.
    The radius is no smaller than ``reach`` standard deviations from the mean.
    """
    bits = 8 * codes.shape[1]
    if not len(model.sample) or wanted >= rows:
        return np.full(len(codes), bits)
    share = wanted / rows
    out = np.zeros(len(codes), int)
    z = _normal_quantile(share)
    z = z if reach is None else max(z, reach)
    for i, code in enumerate(codes):
        apart = np.bitwise_count(model.sample ^ code).sum(axis=1)
        out[i] = int(np.ceil(max(apart.mean() + z * max(apart.std(), 1.0), 0)))
        if share * len(model.sample) >= 20:
            out[i] = max(out[i], int(np.quantile(apart, share)))
    return np.minimum(out, bits)


def _measure(rows: DataFrame, asked: pa.Table, model: CodeModel, k: int, recall: float) -> tuple[int, float | None]:
    """Number of rows, and the reach (see ``_radii``) that covers ``recall`` of the ``k`` best rows of the queries ``asked``.

    One pass: every task keeps k rows per query.
    """
    query_ids, y = asked.column("vec_id").to_numpy(), _matrix(asked.column("embedding"), model.dim)
    codes = model.codes(y, False)
    mean, deviation = _spread(codes, model) if len(codes) else (np.zeros(0), np.ones(0))
    shared = rows.sparkSession.sparkContext.broadcast((model, query_ids, y, codes))

    def run(batches):
        m, own, y, codes = shared.value
        n, at = 0, np.arange(len(own))[:, None]
        score, ids, apart = np.zeros((len(own), 0)), np.zeros((len(own), 0), np.int64), np.zeros((len(own), 0), np.int32)
        for batch in batches:
            n += len(batch)
            here, x = batch.column(0).to_numpy(), _matrix(pa.chunked_array([batch.column(1)]), m.dim)
            if not len(here) or not len(own):
                continue
            product = np.where(here == own[:, None], -np.inf, y @ x.T)
            top = np.argpartition(-product, min(k, len(here)) - 1, axis=1)[:, :k]
            stored = m.codes(x, True)
            far = np.array([np.bitwise_count(stored[t] ^ c).sum(axis=1) for t, c in zip(top, codes, strict=True)])
            score, ids = np.hstack([score, product[at, top]]), np.hstack([ids, here[top]])
            apart = np.hstack([apart, far.astype(np.int32)])
            best = np.argsort(-score, axis=1, kind="stable")[:, :k]
            score, ids, apart = score[at, best], ids[at, best], apart[at, best]
        held = score > -np.inf
        query = np.nonzero(held)[0]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.append(query, -1).astype(np.int32)),
                pa.array(np.append(score[held], 0.0)),
                pa.array(np.append(ids[held], n).astype(np.int64)),
                pa.array(np.append(apart[held], 0).astype(np.int32)),
            ],
            ["q", "score", "id", "apart"],
        )

    found = rows.select("vec_id", "embedding").mapInArrow(run, "q int, score double, id long, apart int")
    # the counts of the tasks (q = -1) are summed, of the others the best of all tasks stay
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "id"))
    found = found.withColumn("rank", rank).filter((F.col("q") < 0) | (F.col("rank") <= k)).toArrow()
    q, apart = found.column("q").to_numpy(), found.column("apart").to_numpy()
    total = int(found.column("id").to_numpy()[q < 0].sum())
    q, apart = q[q >= 0], apart[q >= 0]
    if not len(q):
        return total, None
    return total, float(np.quantile((apart - mean[q]) / deviation[q], recall, method="higher"))


def _normal_quantile(p: float) -> float:
    from statistics import NormalDist

    return NormalDist().inv_cdf(min(max(p, 1e-12), 1 - 1e-12))


def _usable(vectors: DataFrame) -> DataFrame:
    """Vectors that can be compared: all components finite, not all zero, and of the most frequent number of components."""
    good = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select("vec_id", "embedding").filter(
        F.col("vec_id").isNotNull()
        & F.col("embedding").isNotNull()
        & good
        & F.exists("embedding", lambda x: x != 0)
    )
    sizes = rows.groupBy(F.size("embedding").alias("dim")).count()
    dim = sizes.agg(F.max_by("dim", F.struct("count", -F.col("dim")))).first()[0]
    return rows.filter(F.size("embedding") == F.lit(dim))


def nearest_vectors(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 20,
    wanted: int = 400,
    model: CodeModel | None = None,
    recall: float = 0.97,
) -> DataFrame:
    """For every query the ``k`` vectors of largest inner product that the index finds: query_id, rank, vec_id, score.

    ``vectors`` and ``queries`` are (vec_id, embedding); a vector is not found
    by a query of its own id. The library has no vectors of its own records, so
    this is for any table of embeddings. Vectors that are null, zero, of an
    uncommon length or with a null or non-finite component take no part.
    ``wanted`` codes at least are to lie within a query's radius, and ``recall``
    of the true neighbours of a sample of the queries, which are compared with
    all rows. A radius grows until a block has given its share of k, so every query has
    k rows or all there are. Nearest come
    first, ties in order of vec_id. Rows with equal ids and vectors are one row.
    Of equal vectors only the k + 1 smallest ids can be among the results, so
    the others are left out before blocks are made.
    """
    rows = _usable(vectors)
    model = model or learn_codes(rows)
    schema = "query_id long, rank int, vec_id long, score double"
    if model is None:
        return vectors.sparkSession.createDataFrame([], schema)
    same = F.row_number().over(Window.partitionBy("embedding").orderBy("vec_id"))
    rows = rows.distinct().withColumn("_same", same).filter(F.col("_same") <= k + 1).drop("_same")
    asked = _usable(queries).distinct().filter(F.size("embedding") == model.dim)
    n_asked = asked.count()
    some = asked.withColumnRenamed("vec_id", "media_id")
    some = some if n_asked <= MEASURED else draw(some, F.lit(MEASURED / n_asked))
    total, reach = _measure(rows, some.select(F.col("media_id").alias("vec_id"), "embedding").toArrow(), model, k, recall)
    blocks = max(1, -(-total // ROWS))
    # what every block gives to each query, so that all give k together
    least = -(-k // blocks)
    shared = vectors.sparkSession.sparkContext.broadcast(model)

    block = F.pmod(F.xxhash64(F.lit(5), "vec_id"), F.lit(blocks)).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    held = rows.select(block.alias("block"), F.lit(False).alias("asks"), "vec_id", "embedding")
    passing = asked.select(every.alias("block"), F.lit(True).alias("asks"), "vec_id", "embedding")

    def answers(index: MultiIndex, ids: np.ndarray, x: np.ndarray, part: pa.RecordBatch) -> pa.RecordBatch:
        """What the queries of a batch find in a block."""
        m = shared.value
        query_ids, y = part.column(2).to_numpy(), _matrix(pa.chunked_array([part.column(3)]), m.dim)
        codes = m.codes(y, False)
        found: list[tuple[np.ndarray, ...]] = []
        for i, radius in enumerate(_radii(codes, m, total, wanted, reach)):
            near, step = index.within(codes[i], int(radius)), 1
            near = near[ids[near] != query_ids[i]]
            while len(near) < least and radius < 8 * codes.shape[1]:
                radius, step = radius + step, 2 * step
                near = index.within(codes[i], int(radius))
                near = near[ids[near] != query_ids[i]]
            if step > 1 and len(near) > least:
                # the smallest radius that gives as many
                apart = np.bitwise_count(index.codes[near] ^ codes[i]).sum(axis=1)
                near = near[apart <= np.partition(apart, least - 1)[least - 1]]
            score = (x[near] * y[i]).sum(axis=1)
            best = np.lexsort((ids[near], -score))[:k]
            found.append((np.full(len(best), query_ids[i]), ids[near][best], score[best]))
        query, near, score = (np.concatenate(c) for c in zip(*found, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(query), pa.array(near), pa.array(score)], ["query_id", "vec_id", "score"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of a block come before the queries that pass by it."""
        number, stored, index = None, [], None
        for batch in batches:
            at, asks = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False)
            edges = np.flatnonzero((np.diff(at) != 0) | (asks[1:] != asks[:-1])) + 1
            for a, b in zip([0, *edges.tolist()], [*edges.tolist(), batch.num_rows], strict=True):
                part = batch.slice(a, b - a)
                if at[a] != number:
                    number, stored, index = at[a], [], None
                if not asks[a]:
                    stored.append(part)
                    continue
                if index is None and stored:
                    whole = pa.Table.from_batches(stored)
                    ids, x = whole.column(2).to_numpy(), _matrix(whole.column(3), shared.value.dim)
                    index, stored = MultiIndex(shared.value.codes(x, True)), []
                if index is not None:
                    yield answers(index, ids, x, part)

    met = held.union(passing).repartitionById(blocks, F.col("block")).sortWithinPartitions("block", "asks", "vec_id")
    found = met.mapInArrow(search, "query_id long, vec_id long, score double")
    # as many rows per query as there are blocks, k each
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    flat = column.combine_chunks()
    flat = flat.chunk(0) if isinstance(flat, pa.ChunkedArray) else flat
    return flat.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, dim)
