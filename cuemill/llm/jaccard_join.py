"""N-gram Jaccard join of transcripts through a token-group matrix.

Two transcripts link when their sets of word n-grams overlap by at least 75 % of
their union. The join keeps, for groups of similar transcripts, the union of
their n-grams (a column of the token-group matrix), bounds how much of a query
transcript a group can hold, and compares it with the group's members only when
the bound allows a link:

1. Every transcript becomes a set of 64-bit n-gram fingerprints. Equal sets are
   one class from here on, so exact copies cost one row each.
2. A sketch counts all n-grams of the corpus in a fixed number of counters. It
   orders n-grams from rare to common. Of a set of n, a partner holds at least
   ceil(0.75 n), so two linked sets share one of their n - ceil(0.75 n) + 1
   rarest n-grams: only these enter the matrix. Any fixed order keeps this exact.
3. Groups: among the classes of one n-gram, the one whose n-grams are most
   shared and one other lead. Classes are compared with their leaders, and links
   found make groups (connected components).
4. Matrix: n-gram and group. Two groups are candidates if they meet in a column
   that can be the first n-gram of a link: of the smaller set at least
   2 * 75 / 175 must lie from there on, so a passage that many sets share after
   more than a seventh of their own brings none of them together. A group is held
   in slices of bounded size, each with its union.
   A class is compared with the members of a slice only if the union holds
   ceil(0.75 n) of its n-grams.
5. Links of both steps give the components.

No pairs are written for classes already in one group, so a group of many
near-copies costs its members and not their square.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from cuemill.llm.batches import slices, utf8
from cuemill.llm.bits import bit_table, holds
from cuemill.llm.graph import components
from cuemill.llm.stored import stored
from cuemill.llm.words import NOT_BLANK, mix, signed, whole, windows, words

# Counters of the sketch; more of them tell common n-grams apart at lower counts.
SKETCH_BITS = 20
_PART_BITS = 14
# Bits of the table of wanted classes; when it fills up, more sets are made than are needed.
_WANTED_BITS = 22
# Members of a group, and queries, that one task holds at once.
MEMBERS, QUERIES = 256, 1024
# Meetings of groups in one column that one task writes.
_MEETINGS = 1 << 20


def ngram_sets(texts: pa.Array, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct n-gram fingerprints) of every text with a word."""
    raw, offsets = utf8(texts)
    for i, j in slices(offsets):
        w, at = words(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], NOT_BLANK)
        grams = windows(w, n)
        for k in range(j - i):
            a, b = at[k], at[k + 1]
            if b - a >= n:
                yield i + k, np.unique(grams[a : b - n + 1])
            elif b > a:
                yield i + k, np.array([whole(w[a:b])], np.uint64)


def set_id(grams: np.ndarray) -> int:
    """Fingerprint of a set."""
    total = np.array([mix(grams).sum(dtype=np.uint64) + np.uint64(len(grams))], np.uint64)
    return int(signed(mix(total))[0])


def _classes_and_counts(transcripts: DataFrame, n: int) -> DataFrame:
    """Rows (media_id, n_shingles, cls), and per task the parts of its sketch (part, counts)."""
    media = transcripts.schema["media_id"]
    kind = pa.int64() if isinstance(media.dataType, LongType) else None
    shift, width = np.uint64(64 - SKETCH_BITS), 1 << SKETCH_BITS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(width, np.int64)
        id_type = kind
        for batch in batches:
            ids, texts = batch.columns
            id_type = ids.type
            size, cls = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
            held: list[np.ndarray] = []
            for row, grams in ngram_sets(texts, n):
                size[row], cls[row] = len(grams), set_id(grams)
                held.append(grams >> shift)
                if len(held) == 1000:
                    counts += np.bincount(np.concatenate(held).view(np.int64), minlength=width)
                    held = []
            if held:
                counts += np.bincount(np.concatenate(held).view(np.int64), minlength=width)
            empty = pa.array(size == 0)
            yield pa.RecordBatch.from_arrays(
                [
                    ids,
                    pa.array(size),
                    pa.array(cls, mask=size == 0),
                    pa.nulls(len(empty), pa.int32()),
                    pa.nulls(len(empty), pa.binary()),
                ],
                ["media_id", "n_shingles", "cls", "part", "counts"],
            )
        if counts.any():
            parts = counts.reshape(-1, 1 << _PART_BITS)
            m = len(parts)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.nulls(m, id_type),
                    pa.nulls(m, pa.int64()),
                    pa.nulls(m, pa.int64()),
                    pa.array(range(m), pa.int32()),
                    pa.array([zlib.compress(p.tobytes(), 1) for p in parts], pa.binary()),
                ],
                ["media_id", "n_shingles", "cls", "part", "counts"],
            )

    schema = f"media_id {media.dataType.simpleString()}, n_shingles long, cls long, part int, counts binary"
    return transcripts.select("media_id", "text").mapInArrow(run, schema)


def _sketch(parts: DataFrame) -> np.ndarray:
    """Sum of the tasks' counts; 2 ** SKETCH_BITS numbers reach the driver, whatever the corpus."""

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, counts in zip(batch["part"], batch["counts"], strict=True):
                here = np.frombuffer(zlib.decompress(counts), np.int64)
                sums[part] = sums[part] + here if part in sums else here
        if sums:
            yield pd.DataFrame({"part": list(sums), "counts": [s.tobytes() for s in sums.values()]})

    # first within each task's share, then per part
    rows = parts.mapInPandas(_squeezed(add), "part int, counts binary").repartition("part").mapInPandas(
        add, "part int, counts binary"
    )
    counts = np.zeros((1 << (SKETCH_BITS - _PART_BITS), 1 << _PART_BITS), np.int64)
    for row in rows.collect():
        counts[row["part"]] += np.frombuffer(row["counts"], np.int64)
    return counts.reshape(-1)


def _squeezed(add):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for out in add(batches):
            out["counts"] = [zlib.compress(c, 1) for c in out["counts"]]
            yield out

    return run


def _rarest(transcripts: DataFrame, n: int, percent: int, order: Broadcast) -> DataFrame:
    """(token, cls, n, rest): of every set the n-grams of which a linked set holds at least one.

    ``rest`` counts the n-gram and those after it in the corpus order: if it is
    the first one that two sets share, they share no more than either rest.
    ``order`` has the count of every slot of the sketch.
    """
    shift = np.uint64(64 - SKETCH_BITS)
    low = np.uint64(2**32 - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank = order.value
        for batch in batches:
            seen: set[int] = set()
            tokens, cls, size, kept, rest = [], [], [], [], []

            def rows():
                return pa.RecordBatch.from_arrays(
                    [
                        pa.array(signed(np.concatenate(tokens))),
                        pa.array(np.repeat(np.array(cls, np.int64), kept)),
                        pa.array(np.repeat(np.array(size, np.int32), kept)),
                        pa.array(np.concatenate(rest).astype(np.int32)),
                    ],
                    ["token", "cls", "n", "rest"],
                )

            for _, grams in ngram_sets(batch.column(0), n):
                here = set_id(grams)
                if here in seen:
                    continue
                seen.add(here)
                m = len(grams)
                k = m + (-percent * m // 100) + 1
                # rare ones first; equal counts by fingerprint, in which order the set comes
                key = (rank[grams >> shift].astype(np.uint64) << np.uint64(32)) | (grams & low)
                tokens.append(grams[np.argsort(key, kind="stable")[:k]])
                cls.append(here)
                size.append(m)
                kept.append(k)
                rest.append(m - np.arange(k))
                if len(kept) >= 2000:
                    yield rows()
                    tokens, cls, size, kept, rest = [], [], [], [], []
            if kept:
                yield rows()

    return transcripts.select("text").mapInArrow(run, "token long, cls long, n int, rest int")


def _wanted(transcripts: DataFrame, wanted: DataFrame) -> Broadcast:
    """A bit table of fixed size with the ids of the classes ``wanted`` (cls, media_id)."""
    return transcripts.sparkSession.sparkContext.broadcast(bit_table(wanted, F.xxhash64("media_id"), _WANTED_BITS))


def _sets_of(transcripts: DataFrame, n: int, table: Broadcast) -> DataFrame:
    """(cls, grams) for at least the classes wanted, one row each: the n-gram set as bytes.

    A bit ``table`` of fixed size, made of all wanted ids, spares making most other
    sets. Copies whose ids share a wanted one's bits, and repeated rows, give the
    same class again: each task keeps one of them, and one of all tasks stays.
    """
    slot = F.xxhash64("media_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = table.value
        made: set[int] = set()
        for batch in batches:
            near = np.flatnonzero(holds(held, batch.column(0).to_numpy().view(np.uint64)))
            cls, grams = [], []
            for _, g in ngram_sets(batch.column(1).take(pa.array(near)), n):
                here = set_id(g)
                if here not in made:
                    made.add(here)
                    cls.append(here)
                    grams.append(g.tobytes())
            if grams:
                yield pa.RecordBatch.from_arrays([pa.array(cls, pa.int64()), pa.array(grams, pa.binary())], ["cls", "grams"])

    sets = transcripts.select(slot.alias("s"), "text").mapInArrow(run, "cls long, grams binary")
    # moved once by class, which the joins that follow need as well
    return sets.repartition("cls").dropDuplicates(["cls"])


def _linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _check_pairs(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets link."""

    @F.pandas_udf("boolean")
    def links(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(
            [_linked(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent) for x, y in zip(a, b, strict=True)]
        )

    left = sets.select(F.col("cls").alias("a"), F.col("grams").alias("grams_a"))
    right = sets.select(F.col("cls").alias("b"), F.col("grams").alias("grams_b"))
    rows = pairs.join(left, "a").join(right, "b")
    return rows.filter(links("grams_a", "grams_b")).select("a", "b")


def _may_link(n1, rest1, n2, rest2, percent: int):
    """What two sets of n1 and n2 can share is enough, if this is the first n-gram that they share."""
    shared = F.least(rest1, rest2).cast("long")
    return shared * (100 + percent) >= (n1 + n2) * percent


def _may_lead(n, rest, percent: int):
    """A set of n can share enough with one of its size or larger, if this is the first n-gram that they share."""
    return rest.cast("long") * (100 + percent) >= n.cast("long") * (2 * percent)


def _enough(met, low, high, percent: int):
    """Sets of ``low`` to ``high`` n-grams may link if they meet in ``met`` columns of the matrix.

    Those are the first ones they share. What they share besides lies beyond the
    columns of one of them, where less than ``percent`` of its n-grams are left,
    and percent / (100 + percent) of both together must be shared.
    """
    low, high = low.cast("long"), high.cast("long")
    most = (met - 1) * 100 + high * percent + 100
    return most * (100 + percent) >= (low + high) * 100 * percent


def _leader_pairs(columns: DataFrame, percent: int) -> DataFrame:
    """Classes with the leaders of their n-grams, a < b, that may link by the columns in which one leads the other."""
    shared = columns.groupBy("cls").agg(F.count("*").alias("shared"))
    ranked = columns.join(shared, "cls")
    lead = ranked.groupBy("token").agg(
        F.max_by(F.struct("cls", "n", "rest"), F.struct("shared", "cls")).alias("first"),
        F.min(F.struct("cls", "n", "rest")).alias("other"),
    )
    rows = columns.join(lead, "token")
    pairs = rows.select("token", "cls", "n", "rest", F.explode(F.array_distinct(F.array("first", "other"))).alias("l"))
    near = _may_link(F.col("n"), F.col("rest"), F.col("l.n"), F.col("l.rest"), percent)
    met = pairs.filter(F.col("cls") != F.col("l.cls")).groupBy(
        F.least("cls", "l.cls").alias("a"), F.greatest("cls", "l.cls").alias("b")
    )
    met = met.agg(
        F.count("*").alias("met"),
        F.least(F.min("n"), F.min("l.n")).alias("low"),
        F.greatest(F.max("n"), F.max("l.n")).alias("high"),
        F.max(near).alias("near"),
    )
    return met.filter(F.col("near") & _enough(F.col("met"), F.col("low"), F.col("high"), percent)).select("a", "b")


def _group_queries(columns: DataFrame, groups: DataFrame, percent: int) -> DataFrame:
    """(cls, group): classes and the other groups they meet in enough columns of the matrix, sizes allowing.

    Of two groups that meet, the classes of the one with fewer members are the queries.
    """
    size = groups.groupBy("group").agg(F.count("*").alias("members"), F.min("n").alias("low"), F.max("n").alias("high"))
    side = groups.select("cls", "group").join(size, "group").select("cls", F.struct("members", "group", "low", "high").alias("g"))
    rows = columns.select("token", "cls", "rest", _may_lead(F.col("n"), F.col("rest"), percent).alias("leads")).join(side, "cls")
    matrix = rows.groupBy("token", "g").agg(F.max("rest").alias("rest"), F.max("leads").alias("leads"))
    # at the first n-gram of a link the smaller set leads: columns in which no group has such a member bring no pair
    met = matrix.groupBy("token").agg(F.count("*").alias("k"), F.count_if("leads").alias("leaders")).filter("k > 1 and leaders > 0")
    shares = F.ceil(F.col("k") * F.col("leaders") / F.lit(_MEETINGS)).cast("int")
    first = matrix.join(met.select("token", F.least(shares, "leaders").cast("int").alias("shares")), "token")
    one = first.filter("leads").withColumn("share", F.pmod(F.xxhash64("g.group"), F.col("shares")).cast("int"))
    one = one.select("token", "share", F.col("g").alias("one"), F.col("rest").alias("rest1"))
    other = first.withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)))
    other = other.select("token", "share", F.col("g").alias("other"), F.col("rest").alias("rest2"), "leads")
    near = _may_link(F.col("one.low"), F.col("rest1"), F.col("other.low"), F.col("rest2"), percent)
    # two that both lead meet once
    once = (F.col("one") < F.col("other")) | (~F.col("leads") & (F.col("one") != F.col("other")))
    pairs = one.join(other, ["token", "share"]).filter(once & near)
    # every group with those that are larger: by members, then by id
    pairs = pairs.select(F.least("one", "other").alias("small"), F.greatest("one", "other").alias("large")).distinct()
    # every column that two groups share counts
    left = pairs.join(matrix.select(F.col("g").alias("small"), "token"), "small")
    pairs = left.join(matrix.select(F.col("g").alias("large"), "token"), ["large", "token"])
    pairs = pairs.groupBy("small", "large").agg(F.count("*").alias("met"))
    low, high = F.least("small.low", "large.low"), F.greatest("small.high", "large.high")
    pairs = pairs.filter(_enough(F.col("met"), low, high, percent))
    pairs = pairs.select(F.col("small.group").alias("small"), F.col("large.group").alias("group"))
    members = groups.select("cls", F.col("group").alias("small"))
    return pairs.join(members, "small").select("cls", "group")


def _open_groups(queries: DataFrame, groups: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) of queries (cls, group) with members of the group, one for each slice of it at most."""
    size = groups.groupBy("group").agg(F.ceil(F.count("*") / MEMBERS).cast("int").alias("slices"))
    asked = queries.groupBy("group").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("parts"))
    shape = size.join(asked, "group")
    pick = F.pmod(F.xxhash64("cls"), F.lit(1 << 30))
    left = (
        groups.join(shape, "group")
        .withColumn("slice", (pick % F.col("slices")).cast("int"))
        .withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .join(sets, "cls")
        .select("group", "slice", "part", "cls", "grams")
    )
    right = (
        queries.join(shape, "group")
        .withColumn("part", (pick % F.col("parts")).cast("int"))
        .withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
        .join(sets, "cls")
        .select(*[F.col(c).alias(f"q_{c}") for c in ("group", "slice", "part", "cls", "grams")])
    )

    def compare(members: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        found: list[tuple[int, int]] = []
        if len(members) and len(asked):
            held = [np.frombuffer(g, np.uint64) for g in members["grams"]]
            tokens = np.concatenate(held)
            owner = np.repeat(np.arange(len(held)), [len(g) for g in held])
            by = np.argsort(tokens, kind="stable")
            tokens, owner = tokens[by], owner[by]
            sizes = np.array([len(g) for g in held])
            for cls, grams in zip(asked["q_cls"], asked["q_grams"], strict=True):
                q = np.frombuffer(grams, np.uint64)
                low, high = np.searchsorted(tokens, q), np.searchsorted(tokens, q, side="right")
                inside = high > low
                if 100 * int(inside.sum()) < percent * len(q):
                    continue  # the union of the slice holds too little of the query
                low, count = low[inside], (high - low)[inside]
                at = np.repeat(low - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(count.sum())
                both = np.bincount(owner[at], minlength=len(held))
                hit = np.flatnonzero(100 * both >= percent * (len(q) + sizes - both))
                if len(hit):
                    found.append((cls, int(members["cls"].iloc[hit[0]])))
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    keys = ["group", "slice", "part"]
    asked_keys = [f"q_{k}" for k in keys]
    return left.groupBy(*keys).cogroup(right.groupBy(*asked_keys)).applyInPandas(compare, "a long, b long")


def jaccard_components(transcripts: DataFrame, n: int = 5, percent: int = 75) -> DataFrame:
    """Near-duplicate transcripts: media_id, n_shingles, component_id for every row of (media_id, text).

    Words are runs of anything but ASCII white space, A-Z in lower case. A
    transcript's set holds its distinct ``n``-word shingles; fewer words make one
    shingle. Two transcripts link when 100 * intersection >= ``percent`` * union;
    component_id is the smallest media_id that links lead to. A text without a
    word (or null) has 0 shingles and is its own component; rows with an equal
    media_id are separate rows. Other columns are not looked at. Fingerprints
    have 64 bits: the chance that any two of a million sets are confused is about
    3e-8.
    """
    sc = transcripts.sparkSession.sparkContext
    rows = stored(_classes_and_counts(transcripts, n))
    docs = rows.filter("part is null").select("media_id", "n_shingles", "cls")
    counts = _sketch(rows.filter("part is not null").select("part", "counts"))
    classes = docs.filter("cls is not null").groupBy("cls").agg(F.min("media_id").alias("media_id"))

    # broadcasts are given back once what was made with them is stored
    order = sc.broadcast(np.minimum(counts, 2**31 - 1).astype(np.uint32))
    rare = _rarest(transcripts, n, percent, order).repartition("token")
    # all columns are read, so that the exchange of rare serves both sides
    held = rare.groupBy("token").agg(F.min("cls").alias("x"), F.max("cls").alias("y"), F.max(F.col("n") + F.col("rest")).alias("z"))
    held = held.filter("x <> y and z > 0").select("token")
    columns = stored(rare.join(held, "token").distinct())
    order.destroy()

    pairs = stored(_leader_pairs(columns, percent))
    ends = pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct()
    table = _wanted(transcripts, ends.join(classes, "cls"))
    led = components(_check_pairs(pairs, _sets_of(transcripts, n, table), percent))
    table.destroy()
    groups = columns.select("cls", "n").distinct().join(led.withColumnRenamed("node", "cls"), "cls", "left")
    groups = stored(groups.select("cls", "n", F.coalesce("root", "cls").alias("group")))

    queries = stored(_group_queries(columns, groups, percent))
    opened = groups.join(queries.select("group").distinct(), "group").select("cls", "group")
    ends = queries.select("cls").union(opened.select("cls")).distinct()
    table = _wanted(transcripts, ends.join(classes, "cls"))
    more = _open_groups(queries, opened, _sets_of(transcripts, n, table), percent)

    # groups are nodes now: the first links are in them already
    ends = more.join(groups.select(F.col("cls").alias("a"), F.col("group").alias("g")), "a")
    ends = ends.join(groups.select(F.col("cls").alias("b"), F.col("group").alias("h")), "b")
    merged = components(ends.select(F.col("g").alias("a"), F.col("h").alias("b")))
    table.destroy()
    final = groups.join(merged.withColumnRenamed("node", "group"), "group", "left")
    final = final.select("cls", F.coalesce("root", "group").alias("root"))

    named = classes.join(final, "cls", "left").select("cls", "media_id", F.coalesce("root", "cls").alias("root"))
    least = named.groupBy("root").agg(F.min("media_id").alias("component_id"))
    named = named.join(least, "root").select("cls", "component_id")
    full = docs.filter("cls is not null").join(named, "cls").select("media_id", "n_shingles", "component_id")
    none = docs.filter("cls is null").select("media_id", "n_shingles", F.col("media_id").alias("component_id"))
    return full.union(none)
