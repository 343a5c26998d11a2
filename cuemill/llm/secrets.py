"""Secrets in transcripts through a trigram inverted index.

Every rule's pattern becomes a Boolean query over the trigrams that any match
must hold. Each batch of transcripts is indexed on its own (trigram -> the
transcripts with it, for the trigrams that queries ask about), postings are
intersected and united as the query says, and only the transcripts left are
scanned with the pattern. A rule whose pattern demands no trigram is scanned in
all transcripts. Nothing is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from cuemill.llm.batches import add_columns, slices, utf8
from cuemill.llm.words import LOWER

_tree = re._parser  # the pattern's syntax tree as the standard library has it
# Strings that are spelled out before a part of a pattern counts as unknown.
_SPELLED = 64

# A query is True (anything may match), a trigram, or ("and" | "or", queries).
Query = bool | str | tuple


@dataclass(frozen=True)
class Rule:
    """A kind of secret: where it matches, and how long ``group`` of a match must be to count."""

    kind: str
    pattern: str
    group: int
    at_least: int
    flags: int = re.ASCII
    query: Query = field(init=False)

    def __post_init__(self):
        object.__setattr__(self, "query", trigram_query(self.pattern, self.flags))


def _both(queries: Sequence[Query]) -> Query:
    parts = list(dict.fromkeys(q for q in queries if q is not True))
    return True if not parts else parts[0] if len(parts) == 1 else ("and", tuple(parts))


def _either(queries: Sequence[Query]) -> Query:
    parts = list(dict.fromkeys(queries))
    if True in parts or not parts:
        return True
    # what holds more trigrams than another alternative adds nothing
    plain = {q: {q} if isinstance(q, str) else set(q[1]) for q in parts if isinstance(q, str) or q[0] == "and"}
    parts = [q for q in parts if not (q in plain and any(o < plain[q] for o in plain.values()))]
    return parts[0] if len(parts) == 1 else ("or", tuple(parts))


def _demanded(strings: set[str]) -> Query:
    """That one of the strings occurs."""
    return _either([_both([s[k : k + 3] for k in range(len(s) - 2)]) for s in sorted(strings)])


def _strings(item, flags: int) -> set[str] | None:
    """All lower-case strings an element can match, if they are few; ASCII only."""
    op, value = item
    name = str(op)
    if name == "LITERAL":
        return {chr(value).lower()} if value < 128 else None
    if name == "IN":
        found: set[str] = set()
        for kind, x in value:
            if str(kind) == "LITERAL" and x < 128:
                found.add(chr(x).lower())
            elif str(kind) == "RANGE" and x[1] < 128 and x[1] - x[0] < _SPELLED:
                found |= {chr(c).lower() for c in range(x[0], x[1] + 1)}
            else:
                return None
        return found if len(found) <= 8 else None
    if name == "SUBPATTERN":
        return _sequence_strings(value[-1], flags)
    if name == "BRANCH":
        parts = [_sequence_strings(b, flags) for b in value[1]]
        return None if None in parts else set().union(*parts)
    if name in ("MAX_REPEAT", "MIN_REPEAT"):
        low, high, inner = value
        if high != 1 and (low, high) != (low, low):
            return None
        once = _sequence_strings(inner, flags)
        if once is None or high > 8:
            return None
        found = {""} if low == 0 else set()
        now = {""}
        for k in range(1, int(high) + 1):
            now = {a + b for a in now for b in once}
            if len(now) > _SPELLED:
                return None
            if k >= low:
                found |= now
        return found
    return None


def _sequence_strings(items, flags: int) -> set[str] | None:
    found = {""}
    for item in items:
        here = _strings(item, flags)
        if here is None:
            return None
        found = {a + b for a in found for b in here}
        if len(found) > _SPELLED:
            return None
    return found


def _query(items, flags: int) -> Query:
    demanded: list[Query] = []
    spelled = {""}
    for item in items:
        here = _strings(item, flags)
        if here is not None and len(spelled) * len(here) <= _SPELLED:
            spelled = {a + b for a in spelled for b in here}
            continue
        demanded.append(_demanded(spelled))
        spelled = here if here is not None else {""}
        if here is not None:
            continue
        op, value = item
        name = str(op)
        if name == "SUBPATTERN":
            demanded.append(_query(value[-1], flags))
        elif name == "BRANCH":
            demanded.append(_either([_query(b, flags) for b in value[1]]))
        elif name in ("MAX_REPEAT", "MIN_REPEAT") and value[0] > 0:
            demanded.append(_query(value[2], flags))
    return _both([*demanded, _demanded(spelled)])


def trigram_query(pattern: str, flags: int = re.ASCII) -> Query:
    """What every match of the pattern holds, as lower-case trigrams; True if nothing is sure."""
    return _query(_tree.parse(pattern, flags), flags)


def _asked(query: Query) -> set[str]:
    if query is True:
        return set()
    return {query} if isinstance(query, str) else set().union(*(_asked(q) for q in query[1]))


# The patterns that all reports share, in the order of their names in results.
BASE_RULES = (
    Rule(
        "assign",
        r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        2,
        12,
        re.ASCII | re.IGNORECASE,
    ),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]+", 0, 16),
)


class TrigramIndex:
    """Postings of a batch of texts: for each trigram asked about, the texts that hold it in any case."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, trigrams: Sequence[str]):
        self.postings = {t: np.zeros(0, np.int64) for t in trigrams}
        if len(raw) < 3 or not trigrams:
            return
        low = LOWER[raw].astype(np.int32)
        codes = (low[:-2] << 16) | (low[1:-1] << 8) | low[2:]
        numbers = {(ord(t[0]) << 16) | (ord(t[1]) << 8) | ord(t[2]): t for t in trigrams}
        known = np.zeros(1 << 24, bool)
        known[list(numbers)] = True
        at = np.flatnonzero(known[codes])
        text = np.searchsorted(offsets, at, side="right") - 1
        inside = at + 3 <= offsets[text + 1]
        found, text = codes[at[inside]], text[inside]
        for code, trigram in numbers.items():
            self.postings[trigram] = np.unique(text[found == code])

    def candidates(self, query: Query, n: int) -> np.ndarray:
        """The texts that satisfy a query, of ``n`` texts."""
        if query is True:
            return np.arange(n)
        if isinstance(query, str):
            return self.postings[query]
        parts = [self.candidates(q, n) for q in query[1]]
        found = parts[0]
        for part in parts[1:]:
            found = np.intersect1d(found, part) if query[0] == "and" else np.union1d(found, part)
        return found


def _spans(texts: pa.Array, rules: Sequence[Rule]) -> list[list[tuple[int, int, int]]]:
    """(from, to, number of the rule) of every text, in order."""
    raw, offsets = utf8(texts)
    asked = sorted(set().union(*(_asked(r.query) for r in rules))) if rules else []
    compiled = [re.compile(r.pattern, r.flags) for r in rules]
    found: list[list[tuple[int, int, int]]] = [[] for _ in range(len(texts))]
    for i, j in slices(offsets):
        index = TrigramIndex(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], asked)
        held = texts.slice(i, j - i).to_pylist()
        for k, (rule, pattern) in enumerate(zip(rules, compiled, strict=True)):
            for row in index.candidates(rule.query, j - i).tolist():
                for m in pattern.finditer(held[row] or ""):
                    low, high = m.span(rule.group)
                    if high - low >= rule.at_least:
                        found[i + row].append((m.start(), m.end(), k))
    for spans in found:
        spans.sort(key=lambda s: (s[0], s[2]))
    return found


_SPANS = "array<struct<kind: string, from: int, to: int>>"


def find_secrets(
    transcripts: DataFrame, rules: Sequence[Rule] = BASE_RULES, keep: tuple[str, ...] = ("media_id",)
) -> DataFrame:
    """``keep`` columns of transcripts (text) with the spans (kind, from, to) of secrets, a row for each row.

    Per kind, matches are taken from the left without overlap, and those whose
    ``group`` is shorter than ``at_least`` are then dropped; places count code
    points, the end is exclusive; order is by start, then by the order of the
    rules. Spans of different kinds may overlap. Null or empty texts have none.
    """
    rules = tuple(rules)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("from", pa.int32()), ("to", pa.int32())]))

    def work(columns):
        rows = [
            [{"kind": rules[k].kind, "from": a, "to": b} for a, b, k in spans] for spans in _spans(columns["text"], rules)
        ]
        return {"spans": pa.array(rows, kind)}

    return add_columns(transcripts, ["text"], keep, f"spans {_SPANS}", work)


def redact_secrets(
    transcripts: DataFrame, rules: Sequence[Rule] = BASE_RULES, keep: tuple[str, ...] = ("media_id",)
) -> DataFrame:
    """``keep`` columns of transcripts and their text, each run of overlapping secrets replaced by ``[kind]`` of its first.

    A null text stays null.
    """
    rules = tuple(rules)

    def work(columns):
        texts = columns["text"].to_pylist()
        for i, spans in enumerate(_spans(columns["text"], rules)):
            if not spans:
                continue
            parts, end, text = [], 0, texts[i]
            for a, b, k in spans:
                if a >= end:
                    parts += [text[end:a], f"[{rules[k].kind}]"]
                end = max(end, b)
            texts[i] = "".join([*parts, text[end:]])
        return {"text": pa.array(texts, pa.string())}

    return add_columns(transcripts, ["text"], keep, "text string", work)
