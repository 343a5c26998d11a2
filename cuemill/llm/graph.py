"""Connected components of a table of links."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from cuemill.llm.stored import stored

# Links of one task that are contracted together.
LINKS = 1 << 20


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of some links, and the smallest node that these links alone connect each with."""
    nodes, place = np.unique(np.concatenate((a, b)), return_inverse=True)
    one, other = place[: len(a)], place[len(a) :]
    root = np.arange(len(nodes))
    while True:
        x, y = root[one], root[other]
        if (x == y).all():
            return nodes, nodes[root]
        least = np.minimum(x, y)
        np.minimum.at(root, x, least)
        np.minimum.at(root, y, least)
        while (root[root] != root).any():
            root = root[root]


def _forests(links: DataFrame) -> DataFrame:
    """(node, root) of the links (a, b) of every task, in parts of bounded size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        rows = 0

        def contracted() -> pa.RecordBatch:
            found = forest(*(np.concatenate(c) for c in zip(*held, strict=True)))
            return pa.RecordBatch.from_arrays([pa.array(x) for x in found], ["node", "root"])

        for batch in batches:
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
            rows += batch.num_rows
            if rows >= LINKS:
                yield contracted()
                held, rows = [], 0
        if rows:
            yield contracted()

    return links.mapInArrow(run, "node long, root long")


def components(links: DataFrame) -> DataFrame:
    """Links (a, b) of long ids -> (node, root): the smallest node reachable, for every node of a link.

    Every task replaces its links by a forest: nodes and their smallest node
    there. A node with several such roots links these, and the components of
    those links, of which there are fewer in each round, name the final root. Ids
    should be hashes: in a chain, only nodes that are smaller than a neighbour go
    on, and of random ones a third doesn't. A node with very many links has one
    root for each part of a task, and its links are never gathered. Links of a node
    with itself are ignored.
    """
    seen = Observation()
    found = _forests(links.filter("a <> b").select("a", "b")).groupBy("node")
    found = found.agg(F.min("root").alias("root"), F.collect_set("root").alias("roots"))
    parents = stored(found.observe(seen, F.count_if(F.size("roots") > 1).alias("open")))
    if not seen.get["open"]:
        return parents.select("node", "root")
    more = parents.filter("size(roots) > 1").select(F.explode("roots").alias("a"), F.col("root").alias("b"))
    above = components(more).select(F.col("node").alias("root"), F.col("root").alias("top"))
    return parents.join(above, "root", "left").select("node", F.coalesce("top", "root").alias("root"))
