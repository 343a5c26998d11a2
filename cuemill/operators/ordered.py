"""Operators over rows in order, for keys of any size.

A window keyed by media alone puts the whole of one long media item into one
task. Here every key is cut into blocks of bounded size by an expression of the
order columns; blocks are worked on in parallel, and only what crosses a block
border (a few rows or one small summary per block) is brought together per key.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Partition of a key that holds the rows next to block borders.
_BORDER = -1


def block_of(column: str | Column, size: int) -> Column:
    """Block number of a non-negative position or time."""
    column = F.col(column) if isinstance(column, str) else column
    # never null, so that every use of a blocked table plans the same exchange
    return F.coalesce(F.floor(column / size), F.lit(0).cast("long"))


def neighbours(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    block: Column,
    lag: dict[str, tuple[Column, int]] | None = None,
    lead: dict[str, tuple[Column, int]] | None = None,
) -> DataFrame:
    """Add columns of the k-th row before (lag) or after (lead) within each key.

    Rows within reach of a border are ordered a second time among themselves.
    """
    lag, lead = lag or {}, lead or {}
    reach = max(k for _, k in [*lag.values(), *lead.values()])
    inside = Window.partitionBy(*keys, "_block").orderBy(*order)
    rows = (
        df.withColumn("_block", block)
        .withColumn("_rank", F.row_number().over(inside))
        .withColumn("_border", (F.col("_rank") <= reach) | F.lead(F.lit(1), reach).over(inside).isNull())
    )
    for name, (value, k) in lag.items():
        rows = rows.withColumn(f"_in_{name}", F.lag(value, k).over(inside))
    for name, (value, k) in lead.items():
        rows = rows.withColumn(f"_in_{name}", F.lead(value, k).over(inside))
        rows = rows.withColumn(f"_has_{name}", F.lead(F.lit(1), k).over(inside).isNotNull())
    rows = rows.withColumn("_part", F.when(F.col("_border"), F.lit(_BORDER)).otherwise(F.col("_block")))
    across = Window.partitionBy(*keys, "_part").orderBy(*order)
    for name, (value, k) in lag.items():
        outer = F.lag(value, k).over(across)
        rows = rows.withColumn(name, F.when(F.col("_rank") > k, F.col(f"_in_{name}")).otherwise(outer))
    for name, (value, k) in lead.items():
        outer = F.lead(value, k).over(across)
        rows = rows.withColumn(name, F.when(F.col(f"_has_{name}"), F.col(f"_in_{name}")).otherwise(outer))
    return rows.select(*df.columns, *lag, *lead)


# How a group's partial results per block are made and put together.
_PARTIAL = {
    "sum": lambda x, at: F.sum(x),
    "min": lambda x, at: F.min(x),
    "max": lambda x, at: F.max(x),
    "first": lambda x, at: F.min_by(F.struct(x.alias("x")), at),
    "last": lambda x, at: F.max_by(F.struct(x.alias("x")), at),
    "list": lambda x, at: F.collect_list(F.struct(at.alias("at"), x.alias("x"))),
}
_MERGE = {
    "sum": lambda x, at: F.sum(x),
    "min": lambda x, at: F.min(x),
    "max": lambda x, at: F.max(x),
    "first": lambda x, at: F.min_by(x, at)["x"],
    "last": lambda x, at: F.max_by(x, at)["x"],
    "list": lambda x, at: F.transform(F.sort_array(F.flatten(F.collect_list(x))), lambda s: s["x"]),
}


def islands(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    block: Column,
    looks_at: Sequence[str],
    breaks: Callable[[Column, Column], Column],
    **results: tuple[str, Column],
) -> DataFrame:
    """Group consecutive rows; a new group starts where breaks(previous, current) holds.

    ``looks_at`` names the columns the test reads from either row; ``results``
    maps an output name to (sum | min | max | first | last | list, column).
    Groups are built and aggregated inside each block, then the groups at block
    borders are compared once more and partial results merged.
    """
    inside = Window.partitionBy(*keys, "_block").orderBy(*order)
    row = F.struct(*looks_at)
    at = F.struct(*order)
    before = F.col("_before")
    parts = (
        df.withColumn("_block", block)
        .withColumn("_before", F.lag(row).over(inside))
        .withColumn("_opens", before.isNull() | breaks(before, row))
        .withColumn(
            "_group", F.sum(F.col("_opens").cast("int")).over(inside.rowsBetween(Window.unboundedPreceding, 0))
        )
        .groupBy(*keys, "_block", "_group")
        .agg(
            F.min(at).alias("_at"),
            F.min_by(row, at).alias("_first"),
            F.max_by(row, at).alias("_last"),
            *[_PARTIAL[kind](x, at).alias(name) for name, (kind, x) in results.items()],
        )
    )
    groups = F.max("_group").over(Window.partitionBy(*keys, "_block"))
    parts = parts.withColumn(
        "_part",
        F.when((F.col("_group") == 1) | (F.col("_group") == groups), F.lit(_BORDER)).otherwise(F.col("_block")),
    )
    across = Window.partitionBy(*keys, "_part").orderBy("_at")
    parts = (
        parts.withColumn("_before", F.lag("_last").over(across))
        .withColumn(
            "_opens", (F.col("_group") > 1) | before.isNull() | breaks(before, F.col("_first"))
        )
        .withColumn(
            "_start",
            F.max(F.when(F.col("_opens"), F.col("_at"))).over(across.rowsBetween(Window.unboundedPreceding, 0)),
        )
    )
    merged = parts.groupBy(*keys, "_start").agg(
        *[_MERGE[kind](F.col(name), F.col("_at")).alias(name) for name, (kind, _) in results.items()]
    )
    return merged.drop("_start")


def chain(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    block: Column,
    payload: Sequence[str],
    reach: int,
    looks_at: Sequence[str],
    jump: Callable[[Callable[[int], dict[str, np.ndarray]]], np.ndarray],
) -> DataFrame:
    """Cut each key's rows greedily into links of 1 .. reach rows.

    A link starts at a key's first row; ``jump(at)`` is the length of a link for
    every row at once: ``at(k)`` holds the integer columns ``looks_at`` of the row
    k places on, and "there", false past the end. Returns keys, link_idx
    (0-based), rows (array of structs) and the row after the link.

    Where a link may start in a block depends on the block before. Each block is
    therefore reduced to a table of ``reach`` entries, "entered at offset e it is
    left at offset x after n links"; those tables are composed along the key,
    then every block cuts its own rows from its known entry.
    """
    item = F.struct(*order, *[c for c in payload if c not in order])
    blocks = (
        df.withColumn("_cell", block)
        # named here so that every use below reads one and the same exchange
        .repartition(*keys, "_cell")
        .groupBy(*keys, "_cell")
        .agg(F.sort_array(F.collect_list(item)).alias("_rows"))
    )
    heads = blocks.select(*keys, "_cell", F.slice("_rows", 1, reach).alias("_head"))
    blocks = blocks.join(_following(heads, keys, reach), [*keys, "_cell"]).select(
        *keys, "_cell", "_to", F.size("_rows").alias("_own"), F.concat("_rows", "_next").alias("_both")
    )
    fields = [F.col("_both")[c] for c in looks_at]
    # the last block of a key hands nothing on, and most keys have one block only
    steps = _block_passes(tuple(looks_at), jump, reach)(F.col("_own"), *fields)
    steps = blocks.filter("_to is not null").select(*keys, "_cell", "_to", steps.alias("_steps"))
    entries = _entries(steps, keys, reach)
    blocks = (
        blocks.join(entries, [*keys, "_cell"], "left")
        .withColumn("_entry", F.coalesce("_entry", F.lit(0)))
        .withColumn("_before", F.coalesce("_before", F.lit(0).cast("long")))
    )
    cuts = _block_cuts(tuple(looks_at), jump)(F.col("_own"), F.col("_entry"), *fields)
    links = F.transform(
        F.col("_cuts"),
        lambda c, k: F.struct(
            (F.col("_before") + k).alias("link_idx"),
            F.slice("_both", c["at"] + 1, c["n"]).alias("rows"),
            F.get("_both", c["at"] + c["n"]).alias("after"),
        ),
    )
    # the outer form: else Spark runs the array expression again to test it for emptiness
    links = blocks.withColumn("_cuts", cuts).select(*keys, F.inline_outer(links))
    return links.filter(F.col("link_idx").isNotNull())


def _lengths(names, jump, columns):
    """Offsets of the lists in a batch and the link length at each of their rows."""
    offsets = columns[0].offsets.to_numpy()
    values = {n: c.values.to_numpy(zero_copy_only=False) for n, c in zip(names, columns)}
    total = len(columns[0].values)
    ends = np.repeat(offsets[1:], np.diff(offsets))
    place = np.arange(offsets[0], offsets[-1])

    def at(k):
        index = place + k
        there = index < ends
        index = np.minimum(index, max(total - 1, 0))
        return {"there": there, **{n: v[index] for n, v in values.items()}}

    lengths = np.zeros(total, dtype=np.int64)
    lengths[offsets[0] : offsets[-1]] = jump(at)
    return offsets, lengths.tolist()


def _block_passes(names, jump, reach):
    """Per block: (exit, links) for each entry offset."""

    @F.arrow_udf("array<struct<exit:int,links:bigint>>")
    def passes(own: pa.Array, *columns: pa.Array) -> pa.Array:
        out = []
        offsets, lengths = _lengths(names, jump, columns)
        for base, n in zip(offsets.tolist(), own.to_pylist()):
            states = [(e, 0) for e in range(reach)]
            for i in range(n - 1, -1, -1):
                leaves, links = states[lengths[base + i] - 1]
                states = [(leaves, links + 1), *states[: reach - 1]]
            out.append([{"exit": e, "links": k} for e, k in states])
        return pa.array(out, pa.list_(pa.struct([("exit", pa.int32()), ("links", pa.int64())])))

    return passes


def _block_cuts(names, jump):
    """Per block: first row and length of every link, from the block's entry on."""

    @F.arrow_udf("array<struct<at:int,n:int>>")
    def cuts(own: pa.Array, entry: pa.Array, *columns: pa.Array) -> pa.Array:
        offsets, lengths = _lengths(names, jump, columns)
        places, sizes, ends = [], [], [0]
        for base, n, i in zip(offsets.tolist(), own.to_pylist(), entry.to_pylist()):
            while i < n:
                step = lengths[base + i]
                places.append(i)
                sizes.append(step)
                i += step
            ends.append(len(places))
        items = pa.StructArray.from_arrays([pa.array(places, pa.int32()), pa.array(sizes, pa.int32())], ["at", "n"])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), items)

    return cuts


def _following(heads: DataFrame, keys: Sequence[str], reach: int) -> DataFrame:
    """The first ``reach`` rows after each cell, and the next cell.

    A cell may hold fewer rows than that, so up to ``reach`` cells are looked at.
    """
    inside = Window.partitionBy(*keys, "_block").orderBy("_cell").rowsBetween(1, reach)
    across = Window.partitionBy(*keys, "_part").orderBy("_cell").rowsBetween(1, reach)
    near = F.size("_near") == reach
    rank = F.row_number().over(Window.partitionBy(*keys, "_block").orderBy("_cell"))
    cell = F.struct("_cell", "_head")
    found = F.when(near, F.col("_near")).otherwise(F.col("_far"))
    return (
        heads.withColumn("_block", block_of("_cell", 1024))
        .withColumn("_near", F.collect_list(cell).over(inside))
        .withColumn("_part", F.when(near & (rank > reach), F.col("_block")).otherwise(F.lit(_BORDER)))
        .withColumn("_far", F.collect_list(cell).over(across))
        .select(
            *keys,
            "_cell",
            F.get(found, F.lit(0))["_cell"].alias("_to"),
            F.slice(F.flatten(found["_head"]), 1, reach).alias("_next"),
        )
    )


def _entries(steps: DataFrame, keys: Sequence[str], reach: int, span: int = 1024) -> DataFrame:
    """Entry offset and earlier links of every block but a key's first, composed in two levels."""
    unmoved = F.transform(F.sequence(F.lit(0), F.lit(reach - 1)), lambda e: F.struct(e, F.lit(0).cast("long")))
    unmoved = unmoved.cast("array<struct<exit:int,links:bigint>>")

    def then(states, s):
        return F.transform(
            states,
            lambda a: F.struct(
                F.get(s["_steps"], a["exit"])["exit"].alias("exit"),
                (a["links"] + F.get(s["_steps"], a["exit"])["links"]).alias("links"),
            ),
        )

    def follow(items, at, name, after):
        """Fold from a known entry, noting the entry before (or after) every item."""
        start = F.struct(at["exit"].alias("exit"), at["links"].alias("links"), F.array().cast(
            f"array<struct<{name}:bigint,exit:int,links:bigint>>").alias("seen"))

        def step(acc, s):
            to = F.get(s["_steps"], acc["exit"])
            exit, links = to["exit"], acc["links"] + to["links"]
            noted = (exit, links) if after else (acc["exit"], acc["links"])
            here = F.struct(s[name].alias(name), noted[0].alias("exit"), noted[1].alias("links"))
            return F.struct(
                exit.alias("exit"), links.alias("links"), F.concat(acc["seen"], F.array(here)).alias("seen")
            )

        return F.aggregate(items, start, step)["seen"]

    spans = (
        steps.withColumn("_span", block_of("_cell", span))
        .groupBy(*keys, "_span")
        .agg(F.sort_array(F.collect_list(F.struct("_cell", "_to", "_steps"))).alias("_items"))
    )
    tops = (
        spans.select(*keys, "_span", F.aggregate("_items", unmoved, then).alias("_steps"))
        .groupBy(*keys)
        .agg(F.sort_array(F.collect_list(F.struct("_span", "_steps"))).alias("_items"))
    )
    origin = {"exit": F.lit(0), "links": F.lit(0).cast("long")}
    tops = tops.select(*keys, F.inline_outer(follow(F.col("_items"), origin, "_span", after=False)))
    spans = spans.join(tops, [*keys, "_span"])
    at = {"exit": F.col("exit"), "links": F.col("links")}
    seen = spans.select(*keys, F.explode_outer(follow(F.col("_items"), at, "_to", after=True)).alias("s"))
    return seen.select(
        *keys, F.col("s._to").alias("_cell"), F.col("s.exit").alias("_entry"), F.col("s.links").alias("_before")
    )


def number_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str], block: Column, name: str) -> DataFrame:
    """Add a 0-based position within each key: rows of earlier blocks plus the rank inside the own block."""
    rows = df.withColumn("_block", block)
    sizes = rows.groupBy(*keys, "_block").count()
    earlier = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select(*keys, "_block", F.coalesce(F.sum("count").over(earlier), F.lit(0).cast("long")).alias("_base"))
    rank = F.row_number().over(Window.partitionBy(*keys, "_block").orderBy(*order))
    return rows.join(bases, [*keys, "_block"]).withColumn(name, F.col("_base") + rank - 1).select(*df.columns, name)


def pairs(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    block: Column,
    looks_at: Sequence[str],
    joins: Callable[[Column, Column], Column],
    follows: Callable[[Column, Column], Column] | None = None,
) -> DataFrame:
    """Put rows together with the next one of their key where joins(row, next) holds, from each key's first row on.

    The test reads given rows only, so in a run of rows that could each join the
    next one every second row, from the first on, does. What a row is follows from
    the number of such rows just before it; blocks count their own and hand the
    count on, one row per block.

    Returns the columns of a pair's first or of a lone row, ``_other`` (the second
    row, or null) and ``_after`` (whether a row comes next). With ``follows`` a lone
    row belongs to the group before it where follows(row before, row) holds, and
    ``_group`` holds the order columns of the first row of the group.
    A test that gives null does not hold.
    """
    inside = Window.partitionBy(*keys, "_block").orderBy(*order)
    earlier = inside.rowsBetween(Window.unboundedPreceding, -1)
    # None where no row depends on the one before
    follows = follows or (lambda before, row: F.lit(False))
    holds = lambda test: F.coalesce(test, F.lit(False))
    row, at = F.struct(*looks_at), F.struct(*order)

    def opens(odd, can, before, row):
        """Whether a row that stands after an odd number of possible pairs or not starts a group."""
        return ~odd & (can | ~holds(follows(before, row)))

    # dealt out before rows carry the next one along: both uses below read one and the same exchange
    rows = df.withColumn("_block", block).repartition(*keys, "_block")
    rows = (
        rows.withColumn("_n", F.row_number().over(inside).cast("long"))
        .withColumn("_next", F.lead(F.struct(*df.columns)).over(inside))
        .withColumn("_prev", F.lag(row).over(inside))
        .withColumn("_can", holds(joins(row, F.col("_next"))))
        .withColumn("_since", F.max(F.when(~F.col("_can"), F.col("_n"))).over(earlier))
        .withColumn("_run", F.col("_n") - F.coalesce("_since", F.lit(0)) - 1)
        .withColumn("_free", F.col("_since").isNull())
    )

    # first and last row of a block wait for their neighbours; the others open a group or not by the parity handed on
    between = F.col("_prev").isNotNull() & F.col("_next").isNotNull()
    mid = {}
    for e in (0, 1):
        odd = (F.col("_run") + F.when(F.col("_free"), e).otherwise(0)) % 2 == 1
        mid[f"_mid{e}"] = F.max(F.when(between & opens(odd, F.col("_can"), F.col("_prev"), row), at))
    ends = F.struct(row.alias("row"), at.alias("at"), F.col("_can").alias("can"), F.col("_prev").alias("prev"), "_run", "_free")
    blocks = rows.groupBy(*keys, "_block").agg(
        F.count("*").alias("_rows"),
        F.min_by(F.struct(*df.columns), "_n").alias("_head"),
        F.min_by(ends, "_n").alias("_first"),
        F.max_by(ends, "_n").alias("_last"),
        *[column.alias(name) for name, column in mid.items()],
    )
    along = Window.partitionBy(*keys).orderBy("_block")
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    single = F.col("_rows") == 1
    handed = F.when(F.col("_last_can"), F.col("_last._run") + 1).otherwise(0)
    blocks = (
        blocks.withColumn("_head_next", F.lead("_head").over(along))
        .withColumn("_tail_prev", F.lag("_last.row").over(along))
        .withColumn("_last_can", holds(joins(F.col("_last.row"), F.col("_head_next"))))
        .withColumn("_base", F.coalesce(F.sum("_rows").over(before), F.lit(0)))
        # position of the last row that cannot join the next one
        .withColumn(
            "_stop",
            F.when(~(F.col("_last._free") & F.col("_last_can")), F.col("_base") + F.col("_rows") - handed),
        )
        .withColumn("_carry", F.col("_base") - F.coalesce(F.max("_stop").over(before), F.lit(0)))
    )
    odd_first = F.col("_carry") % 2 == 1
    odd_last = (F.col("_last._run") + F.when(F.col("_last._free"), F.col("_carry")).otherwise(0)) % 2 == 1
    first_can = F.when(single, F.col("_last_can")).otherwise(F.col("_first.can"))
    last_prev = F.when(single, F.col("_tail_prev")).otherwise(F.col("_last.prev"))
    opened = F.coalesce(
        F.when(opens(odd_last, F.col("_last_can"), last_prev, F.col("_last.row")), F.col("_last.at")),
        F.when(odd_first, F.col("_mid1")).otherwise(F.col("_mid0")),
        F.when(opens(odd_first, first_can, F.col("_tail_prev"), F.col("_first.row")), F.col("_first.at")),
    )
    handed_on = blocks.withColumn("_opened", opened).select(
        *keys, "_block", "_head_next", "_tail_prev", "_carry", F.max("_opened").over(before).alias("_open_before")
    )

    rows = (
        rows.join(handed_on, [*keys, "_block"])
        .withColumn("_next", F.coalesce("_next", "_head_next"))
        .withColumn("_prev", F.coalesce("_prev", "_tail_prev"))
        .withColumn("_can", holds(joins(row, F.col("_next"))))
        .withColumn("_odd", (F.col("_run") + F.when(F.col("_free"), F.col("_carry")).otherwise(0)) % 2 == 1)
        .withColumn("_opens", opens(F.col("_odd"), F.col("_can"), F.col("_prev"), row))
        .withColumn(
            "_group",
            F.coalesce(
                F.max(F.when(F.col("_opens"), at)).over(inside.rowsBetween(Window.unboundedPreceding, 0)), "_open_before"
            ),
        )
    )
    return rows.filter(~F.col("_odd")).select(
        *df.columns,
        F.when(F.col("_can"), F.col("_next")).alias("_other"),
        F.col("_next").isNotNull().alias("_after"),
        "_group",
    )
