"""Ordered operators against loops, with blocks far smaller than the keys."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cuemill.operators.ordered import block_of, chain, islands, neighbours, number_rows, pairs


@pytest.fixture(scope="module")
def data():
    random.seed(1)
    # one key holds most rows
    sizes = {0: 400, 1: 3, 2: 40, 3: 1}
    return [(k, i, random.randint(0, 9)) for k, n in sizes.items() for i in range(n) if i == 0 or random.random() < 0.7]


def by_key(data):
    out = {}
    for k, i, v in data:
        out.setdefault(k, []).append((i, v))
    return out


BLOCKS = [1, 4, 7, 50, 1000]


@pytest.mark.parametrize("size", BLOCKS)
def test_neighbours(spark, data, size):
    df = spark.createDataFrame(data, "k long, i long, v long")
    v = F.col("v")
    out = neighbours(df, ["k"], ["i"], block_of("i", size), lag={"a": (v, 1), "b": (v, 3)}, lead={"c": (v, 2)})
    got = {(r.k, r.i): (r.a, r.b, r.c) for r in out.collect()}
    for k, rows in by_key(data).items():
        for x, (i, _) in enumerate(rows):
            near = [rows[x + d][1] if 0 <= x + d < len(rows) else None for d in (-1, -3, 2)]
            assert got[k, i] == tuple(near)


@pytest.mark.parametrize("size", BLOCKS)
def test_islands(spark, data, size):
    df = spark.createDataFrame(data, "k long, i long, v long")
    out = islands(
        df, ["k"], ["i"], block_of("i", size), ["v"], lambda before, row: row["v"] > before["v"] + 3,
        total=("sum", F.col("v")), first=("first", F.col("i")), last=("last", F.col("i")), items=("list", F.col("v")),
    )
    expected = []
    for k, rows in by_key(data).items():
        group = None
        for i, v in rows:
            if group is None or v > group[-1][-1][1] + 3:
                group = (k, [])
                expected.append(group)
            group[1].append((i, v))
    expected = sorted((k, g[0][0], g[-1][0], sum(v for _, v in g), [v for _, v in g]) for k, g in expected)
    assert sorted((r.k, r["first"], r["last"], r.total, r["items"]) for r in out.collect()) == expected


@pytest.mark.parametrize("size", BLOCKS)
@pytest.mark.parametrize("reach", [2, 5])
def test_chain(spark, data, size, reach):
    df = spark.createDataFrame(data, "k long, i long, v long")

    def jump(at):
        return np.where(at(1)["there"], (at(0)["v"] + at(1)["v"]) % reach + 1, 1)

    out = chain(df, ["k"], ["i"], block_of("i", size), ["v"], reach, ["v"], jump).collect()
    got = sorted(((r.k, r.link_idx, [x.v for x in r["rows"]], r.after.v if r.after else None) for r in out), key=str)
    expected = []
    for k, rows in by_key(data).items():
        v, at, n = [x for _, x in rows], 0, 0
        while at < len(v):
            step = (v[at] + v[at + 1]) % reach + 1 if at + 1 < len(v) else 1
            expected.append((k, n, v[at : at + step], v[at + step] if at + step < len(v) else None))
            at, n = at + step, n + 1
    assert got == sorted(expected, key=str)


@pytest.mark.parametrize("size", BLOCKS)
def test_number_rows(spark, data, size):
    df = spark.createDataFrame(data, "k long, i long, v long")
    out = number_rows(df, ["k"], ["i"], block_of("i", size), "n").collect()
    expected = {(k, i): n for k, rows in by_key(data).items() for n, (i, _) in enumerate(rows)}
    assert {(r.k, r.i): r.n for r in out} == expected


@pytest.mark.parametrize("size", BLOCKS)
@pytest.mark.parametrize("least", [2, 5])
def test_pairs(spark, data, size, least):
    df = spark.createDataFrame(data, "k long, i long, v long")
    out = pairs(
        df, ["k"], ["i"], block_of("i", size), ["v"],
        lambda a, b: (a["v"] >= least) & (b["v"] >= least),
        lambda before, row: row["v"] <= before["v"],
    )
    expected = []
    for k, rows in by_key(data).items():
        x, group = 0, None
        while x < len(rows):
            both = x + 1 < len(rows) and rows[x][1] >= least and rows[x + 1][1] >= least
            if both or x == 0 or rows[x][1] > rows[x - 1][1]:
                group = rows[x][0]
            expected.append((k, rows[x][0], rows[x + 1][0] if both else None, x + 1 < len(rows), group))
            x += 2 if both else 1
    got = [(r.k, r.i, r["_other"] and r["_other"].i, r["_after"], r["_group"].i) for r in out.collect()]
    assert sorted(got) == sorted(expected)
