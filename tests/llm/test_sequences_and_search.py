"""Packing, ranked search and phrases of transcripts against plainly stated rules."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from cuemill.llm import packing, phrases, ranking
from cuemill.llm.packing import cross, cut_pieces, evolve, mutate, new_packing, pack_transcripts
from cuemill.llm.phrases import merged, mine_phrases, pruned
from cuemill.llm.ranking import Tree, parts_of, rank_transcripts
from cuemill.llm.tokens import Vocabulary

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TRANSCRIPT = "media_id long, text string, language string"
WORDS = ["wide", "river", "Über", "stone", "walk", "tall", "x1", "naïve", "the", "of", "a", "sun", "rain", "door", "blue"]


@pytest.fixture(scope="module")
def vocabulary():
    return Vocabulary(public_tokenizers.path("byte_bpe_50k.json"))


def talk(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", ",", ".", "  ", "\t", "\n"]) for _ in range(n))


# packing


def test_ids_are_those_of_the_library(vocabulary):
    exact = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(3)
    old = [chr(c) for c in range(0x250)]
    texts = ["".join(rng.choice(old + [" "] * 300) for _ in range(200)) for _ in range(200)]
    texts += ["".join(old), "".join(c + " " + c for c in old), "", " ", "a" * 5000, "it's 12 o'clock — “so”…", "日本語 ελλ 🙂", "x<|endoftext|>y", "\r\n \n\n  x  "]
    for text in texts:
        assert vocabulary.ids(text).tolist() == exact.encode(text, add_special_tokens=False).ids
    assert vocabulary._fast is not None


def test_only_the_first_piece_is_shorter():
    for n, ends in ((1, [1]), (8, [8]), (9, [1, 9]), (16, [8, 16]), (23, [7, 15, 23])):
        assert cut_pieces(n, 8).tolist() == ends


def packed_well(sizes, packing_, capacity):
    sequence, free = packing_
    used = np.bincount(sequence, weights=sizes, minlength=len(free))
    return (used + free == capacity).all() and (free >= 0).all() and (used > 0).all()


def test_children_hold_every_piece_once():
    rng = np.random.default_rng(5)
    sizes = np.sort(rng.integers(1, 101, 400))[::-1].astype(np.int64)
    parents = [new_packing(sizes, rng.permutation(400), 100) for _ in range(2)]
    for _ in range(50):
        child = cross(sizes, *parents, 100, rng)
        assert packed_well(sizes, child, 100)
        parents[0] = mutate(sizes, child, 100, rng)
        assert packed_well(sizes, parents[0], 100)


def test_evolution_improves_on_its_first_packings():
    rng = np.random.default_rng(6)
    sizes = np.sort(rng.integers(5, 60, 600))[::-1].astype(np.int64)
    first = min(len(new_packing(sizes, rng.permutation(600), 100)[1]) for _ in range(6))
    best = evolve(sizes, [], 100, [1, 2, 3])
    assert packed_well(sizes, best[0], 100) and len(best[0][1]) < first
    assert len(best[0][1]) <= -(-sizes.sum() // 100) + 1
    # an elite that arrives is not lost
    assert len(evolve(sizes, [best[0]], 100, [7])[0][1]) <= len(best[0][1])


def check_packed(rows, found, capacity):
    exact = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    wanted = Counter()
    for media, text, _ in rows:
        ids = exact.encode(text or "", add_special_tokens=False).ids + [0]
        low = 0
        for k, high in enumerate(cut_pieces(len(ids), capacity).tolist()):
            crc = zlib.crc32(np.array(ids[low:high], "<u4").tobytes())
            wanted[(media, k, low, high - low, crc)] += 1
            low = high
    assert Counter((r.media_id, r.piece, r.start, r.length, r.ids_crc32) for r in found) == wanted
    held = defaultdict(list)
    for r in found:
        held[r.sequence_id].append((r.offset, r.length))
    for places in held.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(held)


def test_pack_transcripts(spark, vocabulary, monkeypatch):
    monkeypatch.setattr(packing, "BLOCK", 60)
    rng = random.Random(8)
    rows = [(k, talk(rng, rng.randrange(1, 90)), "en") for k in range(400)]
    rows += [(7, None, None), (None, "", "en"), (None, "no id", None), (9, talk(rng, 3000), "de")] + [(3, "again and again", "en")] * 70
    df = spark.createDataFrame(rows, TRANSCRIPT).selectExpr("*", "1 as piece", "2 as block", "3 as salt")
    found = pack_transcripts(df, vocabulary, 128).collect()
    used = check_packed(rows, found, 128)
    total = sum(r.length for r in found)
    assert used <= -(-total // 128) + 3
    assert pack_transcripts(df.limit(0), vocabulary, 128).collect() == []
    assert pack_transcripts(df.filter("media_id = 7"), vocabulary).count() == 2


# ranked search


def scores(rows, cues, k):
    """Every transcript scored for every cue."""
    terms = [re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(LOWER)) for _, t, _ in rows]
    n, total = sum(map(bool, terms)), sum(map(len, terms))
    df = Counter(w for t in terms for w in set(t))
    counts = [Counter(t) for t in terms]
    found = []
    for cue, text in cues:
        asked = re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
        each = []
        for (media, _, _), t, c in zip(rows, terms, counts, strict=True):
            m = 75 + (25 * len(t) * n) // max(total, 1)
            score = sum(
                math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * ((10**9 * c[w]) // (1000 * c[w] + 12 * m))
                for w in asked
                if c[w]
            )
            if score > 0:
                each.append((-score, media is not None, media or 0))
        for rank, (score, real, media) in enumerate(sorted(each)[:k], 1):
            found.append((cue, rank, media if real else None, -score))
    return sorted(found, key=repr)


@pytest.mark.parametrize("block, leaf, cells, cue_bytes", [(8192, 16, 1 << 21, 1 << 18), (37, 3, 40, 1 << 18), (50, 1, 200, 150)])
def test_rank_transcripts(spark, monkeypatch, block, leaf, cells, cue_bytes):
    for name, value in (("BLOCK", block), ("LEAF", leaf), ("CELLS", cells), ("CUE_BYTES", cue_bytes)):
        monkeypatch.setattr(ranking, name, value)
    rng = random.Random(block)
    rows = [(k, talk(rng, rng.randrange(0, 40)), "en") for k in range(250)]
    rows += [(500 + k % 30, "Blue river, blue door", "en") for k in range(60)]
    rows += [(None, "river of stone", None), (None, None, "en"), (1, "", "en"), (2, "the sun " * 20_000, "en"), (3, "?!", "en")]
    cues = [(1, "the blue River"), (2, None), (3, "nothing of that sort"), (4, "blue blue door"), (4, "blue blue door"), (None, "naïve über x1"), (6, talk(rng, 60)), (7, "zzz")]
    df = spark.createDataFrame(rows, TRANSCRIPT).selectExpr("*", "1 as term", "2 as score", "3 as rank").repartition(4)
    asked = spark.createDataFrame(cues, "cue_idx long, text string").selectExpr("*", "5 as media_id")
    got = sorted((tuple(r) for r in rank_transcripts(df, asked, 5).collect()), key=repr)
    assert got == scores(rows, cues, 5)
    assert rank_transcripts(df.limit(0), asked).count() == 0 == rank_transcripts(df, asked.limit(0)).count()


def test_bounds_hold_and_prune():
    rng = np.random.default_rng(4)
    rows = [np.sort(rng.choice(30, rng.integers(0, 12), replace=False, p=np.arange(30, 0, -1) / 465)) for _ in range(500)]
    at = np.concatenate(([0], np.cumsum([len(r) for r in rows])))
    term, m = np.concatenate(rows), rng.integers(75, 200, 500)
    tf = rng.integers(1, 5, len(term))
    tree = Tree(term, tf, at, m, 30)
    weight = np.arange(1, 31) * 100
    for node in range(len(tree.low)):
        bound = parts_of(weight, tree.most[node], tree.least_m[node])
        for d in range(tree.low[node], tree.high[node]):
            e = slice(tree.at[d], tree.at[d + 1])
            assert (parts_of(weight[tree.term[e]], tree.tf[e], tree.m[d]) <= bound[tree.term[e]]).all()
    leaves = [k for k in range(len(tree.low)) if not tree.children[k]]
    assert sorted(d for k in leaves for d in range(tree.low[k], tree.high[k])) == list(range(500))
    assert sorted(tree.order.tolist()) == list(range(500))
    # the rarest terms alone: most of the tree is never opened
    counts = np.zeros((1, 30))
    counts[0, 27:] = 1
    found = tree.search(weight, counts, np.zeros((1, 3), np.int64))
    assert 3 <= sum(len(d) for _, d, _ in found) < 100


# phrases


def collocations(rows, least, top, inside=80):
    f, n = defaultdict(Counter), Counter()
    for _, text, language in rows:
        language = "und" if language is None else language
        n[language] += 0
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[language] += len(w)
            for size in range(1, 5):
                for i in range(len(w) - size + 1):
                    f[language][tuple(w[i : i + size])] += 1
    out = []
    for language, counts in f.items():
        wanted = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        around = Counter()
        for p, a in wanted.items():
            for size in range(2, len(p)):
                for i in range(len(p) - size + 1):
                    around[p[i : i + size]] = max(around[p[i : i + size]], a)
        rows_ = []
        for p, a in wanted.items():
            if 100 * around[p] >= inside * a:
                continue
            score, _, l, r = min((2000000 * a // (counts[p[:k]] + counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
            rows_.append((-score, -a, " ".join(p).encode(), l, r))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(rows_)[:top], 1):
            out.append((language, rank, phrase.decode(), -a, l, r, n[language], -score))
    return sorted(out)


@pytest.mark.parametrize("capacity, held", [(1 << 20, 1 << 22), (40, 300)])
def test_mine_phrases(spark, monkeypatch, capacity, held):
    monkeypatch.setattr(phrases, "CAPACITY", capacity)
    monkeypatch.setattr(phrases, "_GRAMS", held)
    monkeypatch.setattr(phrases, "_PHRASES", held)
    rng = random.Random(capacity)
    rows = [(k, talk(rng, rng.randrange(0, 60)), rng.choice(["en", "de", None, "und"])) for k in range(300)]
    rows += [(1000, "Wide  river\tstone walk. " * 300, "en")] + [(5, "One two ThREE four five", "fr")] * 40
    rows += [(1, None, "en"), (2, "", "xx"), (3, "?,.\v\f", None), (None, "ÜBER über über\x85über " * 40, "de")]
    df = spark.createDataFrame(rows, TRANSCRIPT).selectExpr("*", "1 as phrase", "2 as a").repartition(5)
    for least, top in ((30, 2000), (8, 7)):
        assert sorted(map(tuple, mine_phrases(df, least, top).collect())) == collocations(rows, least, top)
    assert mine_phrases(df.limit(0)).collect() == []


def test_every_frequent_key_survives_merging():
    rng = np.random.default_rng(9)
    stream = np.concatenate((rng.integers(0, 20_000, 20_000), np.repeat(np.arange(50), 40), np.full(5_000, 77))).astype(np.uint64)
    rng.shuffle(stream)
    least = 40
    capacity = 1_000  # above 27,000 / 40
    keys, counts, taken = np.zeros(0, np.uint64), np.zeros(0, np.int64), 0
    for part in np.array_split(stream, 30):
        k, c = np.unique(part, return_counts=True)
        keys, counts = merged(np.concatenate((keys, k)), np.concatenate((counts, c)))
        keys, counts, taken, grown = pruned(keys, counts, taken, capacity, least)
        assert len(keys) <= capacity == grown
    assert 0 < taken < least
    true = Counter(stream.tolist())
    found = dict(zip(keys.tolist(), counts.tolist(), strict=True))
    assert all(found[k] <= n <= found[k] + taken for k, n in true.items() if k in found)
    assert {k for k, n in true.items() if n >= least} <= {k for k, c in found.items() if c + taken >= least}
    # all counters equal and too many: the capacity gives way, not the guarantee
    keys, counts, taken, grown = pruned(np.arange(100, dtype=np.uint64), np.full(100, 9), 32, 30, 40)
    assert len(keys) == 100 and taken == 32 and grown >= 100
