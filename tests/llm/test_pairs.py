"""Jaccard join and decontamination of transcripts against brute force."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from cuemill.llm import graph, jaccard_join
from cuemill.llm.decontaminate import find_contamination
from cuemill.llm.graph import components
from cuemill.llm.jaccard_join import jaccard_components

TRANSCRIPT = "media_id long, text string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORDS = ["wide", "river", "Über", "stone", "walk", "tall", "x1", "naïve", "the", "of", "a", "sun", "rain", "door", "blue"]


def talk(rng, n):
    return [rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n)]


def linked_components(rows):
    """Smallest id over links, by comparing every two sets."""
    sets = {}
    for key, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
        sets.setdefault((key, text), {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    items = list(sets.items())
    root = list(range(len(items)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (_, a) in enumerate(items):
        for j in range(i):
            b = items[j][1]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                root[find(i)] = find(j)
    least = {}
    for i, ((key, _), _) in enumerate(items):
        least[find(i)] = min(least.get(find(i), key), key)
    return {k: (len(s), least[find(i)]) for i, (k, s) in enumerate(items)}


def near_copies(rng, copies=150):
    base = talk(rng, 60)
    rows = [(1000, " ".join(base)), (1001, " ".join(base).upper()), (1002, " \t".join(base))]
    for k in range(copies):
        words = list(base)
        for _ in range(rng.randrange(4)):
            words[rng.randrange(60)] = f"edit{rng.randrange(10**6)}"
        rows.append((2000 + k, " ".join(words)))
    for k in range(80):
        # half of it is a passage that many have
        rows.append((3000 + k, " ".join(base[:30] + talk(rng, 10 + k % 30))))
    return rows + [(5000 + k, " ".join(talk(rng, rng.randrange(0, 30)))) for k in range(60)]


@pytest.fixture(scope="module")
def crowd():
    rows = near_copies(random.Random(5))
    rows += [(10, None), (11, ""), (12, " \n "), (13, "one"), (14, "ONE"), (15, "two words"), (15, "two words"), (9, "long " * 30_000)]
    random.Random(1).shuffle(rows)
    return rows


@pytest.mark.parametrize("members, queries", [(256, 1024), (7, 5)])
def test_jaccard_components(spark, crowd, monkeypatch, members, queries):
    monkeypatch.setattr(jaccard_join, "MEMBERS", members)
    monkeypatch.setattr(jaccard_join, "QUERIES", queries)
    df = spark.createDataFrame(crowd, TRANSCRIPT).withColumn("cls", F.lit("x")).withColumn("token", F.lit(0)).repartition(5)
    got = jaccard_components(df).collect()
    want = linked_components(crowd)
    assert sorted((r.media_id, r.n_shingles, r.component_id) for r in got) == sorted((k[0], *want[k]) for k in crowd)


def joined_rows(df):
    """Most rows that a join of the executed plan gave."""
    most, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
        elif kind.endswith("QueryStageExec"):
            todo.append(node.plan())
        else:
            if "Join" in kind:
                most = max(most, node.metrics().apply("numOutputRows").value())
            todo += [node.children().apply(k) for k in range(node.children().size())]
    return most


def test_a_passage_of_many_brings_no_pairs_together(spark):
    # 300 sets of 200 n-grams, 160 of them in all: the passage begins after 40 of their own
    columns = [(t, k, 200, 160 - t) for k in range(300) for t in range(11)]
    # two that share their rarest ones meet
    columns += [(1000 + t, k, 200, 200 - t) for k in (0, 1) for t in range(40)]
    columns = spark.createDataFrame(columns, "token long, cls long, n int, rest int")
    groups = spark.createDataFrame([(k, 200, k) for k in range(300)], "cls long, n int, group long")
    found = jaccard_join._group_queries(columns, groups, 75)
    assert [(r.cls, r.group) for r in found.collect()] == [(0, 1)]
    assert 0 < joined_rows(found) < 300 * 40


@pytest.mark.parametrize("meetings", [1 << 20, 50])
def test_components_around_a_common_passage(spark, monkeypatch, meetings):
    monkeypatch.setattr(jaccard_join, "_MEETINGS", meetings)
    rng = random.Random(11)
    passage = talk(rng, 80)
    rows = []
    for k in range(120):
        own = talk(rng, rng.randrange(6, 34))
        at = rng.choice([0, len(own)])
        rows.append((k, " ".join(own[:at] + passage + own[at:])))
    got = jaccard_components(spark.createDataFrame(rows, TRANSCRIPT).repartition(3)).collect()
    want = linked_components(rows)
    assert sorted((r.media_id, r.n_shingles, r.component_id) for r in got) == sorted((k[0], *want[k]) for k in rows)


def test_one_set_of_every_class(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "_WANTED_BITS", 3)
    rows = [(k, "one text that many rows have word by word") for k in range(400)] + [(500, "some other text of six words")] * 2
    df = spark.createDataFrame(rows, TRANSCRIPT).repartition(4)
    wanted = spark.createDataFrame([(1, 0), (2, 500)], "cls long, media_id long")
    cls = [r.cls for r in jaccard_join._sets_of(df, 5, jaccard_join._wanted(df, wanted)).collect()]
    assert len(cls) == len(set(cls)) == 2


def test_jaccard_without_rows_or_links(spark):
    none = jaccard_components(spark.createDataFrame([], TRANSCRIPT))
    assert none.columns == ["media_id", "n_shingles", "component_id"] and none.count() == 0
    got = jaccard_components(spark.createDataFrame([(2, "a b c"), (1, None), (None, "d e f")], TRANSCRIPT)).collect()
    assert {(r.media_id, r.n_shingles, r.component_id) for r in got} == {(2, 1, 2), (1, 0, 1), (None, 1, None)}


@pytest.mark.parametrize("held", [1, 7, 1000])
def test_components_in_rounds(spark, monkeypatch, held):
    """Links of a task contracted few at a time: the same as all at once."""
    monkeypatch.setattr(graph, "LINKS", held)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", held)
    rng = random.Random(held)
    edges = [(rng.randrange(-300, 300), rng.randrange(-300, 300)) for _ in range(250)] + [(5, k) for k in range(400, 450)]
    root = {x: x for e in edges for x in e}

    def find(x):
        return x if root[x] == x else find(root[x])

    for a, b in edges:
        low, high = sorted((find(a), find(b)))
        root[high] = low
    try:
        got = components(spark.createDataFrame(edges, "a long, b long").repartition(6)).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(map(tuple, got)) == sorted((x, find(x)) for x in {x for a, b in edges if a != b for x in (a, b)})


def test_components_of_a_chain_and_a_hub(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 100 + k) for k in range(1, 60)] + [(7, 7), (300, 300)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(41)}, **{100 + k: 100 for k in range(60)}}


def windows_hit(text, items):
    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))

    doc, hit, found = words(text), set(), set()
    for key, item in items:
        w = words(item)
        n = min(10, len(w))
        for i in range(len(w) - n + 1) if w else ():
            for j in range(len(doc) - n + 1):
                if doc[j : j + n] == w[i : i + n]:
                    hit.update(range(j, j + n))
                    found.add(key)
    return len(doc), len(hit), found


def test_contamination(spark):
    rng = random.Random(3)
    items = [(k, " ".join(talk(rng, rng.choice([3, 9, 10, 11, 40])))) for k in range(40)]
    items += [(50, None), (51, "..."), (52, items[0][1]), (53, "same " * 30), (54, "solo")]
    rows = []
    for k in range(200):
        words = talk(rng, rng.randrange(60))
        item = (rng.choice(items)[1] or "").split()
        if k % 2 and item:
            a = rng.randrange(len(item))
            at = rng.randrange(len(words) + 1)
            words[at:at] = item[a : a + rng.choice([5, 9, 10, 12, 40])]
        rows.append((k, rng.choice([" ", ", ", "\n"]).join(words)))
    rows += [(300, None), (301, ""), (302, "same " * 9), (303, "SAME same " * 20), (304, "Solo!"), (7, rows[7][1]), (7, rows[7][1])]
    rows.append((305, "filler " * 20_000 + items[4][1]))
    docs = spark.createDataFrame(rows, TRANSCRIPT).withColumn("hash", F.lit(1)).withColumn("span", F.lit(2)).repartition(4)
    got = find_contamination(docs, spark.createDataFrame(items, "item_id long, text string").withColumn("media_id", F.lit(0)))
    got = sorted((r.media_id, r.n_words, r.n_hit, tuple(sorted(r.item_ids)), sum(h["to"] > h["from"] for h in r.hits) > 0) for r in got.collect())
    want = []
    for key, text in rows:
        n, hit, found = windows_hit(text, items)
        want.append((key, n, hit, tuple(sorted(found)), hit > 0))
    assert got == sorted(want)


def test_contamination_without_items_or_rows(spark):
    docs, none = spark.createDataFrame([(1, "a b c")], TRANSCRIPT), spark.createDataFrame([], "item_id long, text string")
    assert [(r.n_words, r.n_hit, r.item_ids) for r in find_contamination(docs, none).collect()] == [(3, 0, [])]
    assert find_contamination(docs.limit(0), spark.createDataFrame([(1, "a")], "item_id long, text string")).count() == 0


def test_every_long_shared_span_has_a_common_fingerprint():
    from cuemill.llm.decontaminate import GRAM, WINDOW, _fingerprints
    from cuemill.llm.words import windows

    rng = np.random.default_rng(2)
    w = rng.integers(0, 5, 5000).astype(np.uint64)
    chosen = set(_fingerprints(w, np.array([0, len(w)])).tolist())
    assert all(chosen & set(range(i, i + WINDOW - GRAM + 1)) for i in range(len(w) - WINDOW + 1))
    part = w[1000:1010]
    place = _fingerprints(part, np.array([0, 10]))
    assert len(place) == 1 and 1000 + int(place[0]) in chosen
    assert (windows(part, GRAM)[place] == windows(w, GRAM)[1000 + place]).all()


def test_contamination_by_items_without_id(spark):
    docs = spark.createDataFrame([(1, "x one two three y"), (2, "none here")], TRANSCRIPT)
    items = spark.createDataFrame([(None, "One two"), (None, "three"), (4, "two three")], "item_id long, text string")
    got = {r.media_id: (r.n_hit, sorted(map(repr, r.item_ids))) for r in find_contamination(docs, items).collect()}
    assert got == {1: (3, ["4", "None"]), 2: (0, [])}
