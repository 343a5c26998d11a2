"""Main text of web pages by differencing with the page of the nearest address.

Pages of a host are put in order of their paths; a page's partner is the
neighbour whose path shares more characters with its own, pages with all the
same lines being one. The text lines of both are aligned by their longest common
subsequence, and lines that both have are what the site repeats: alignment
proposes to delete them. Then the markup is asked about each line: inside an
article a proposal is turned down, since the partner may be a copy, and lines of
menus, notices, forms and the like go even where the partner has others.
"""

from __future__ import annotations

import hashlib
import html
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuemill.llm.batches import add_columns
from cuemill.operators.ordered import neighbours

# Elements by their role in a page.
_RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "svg", "math", "object", "select", "xmp"}
_VOID = {
    "area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr",
}
_INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img",
    "ins", "kbd", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup",
    "time", "tt", "u", "var", "wbr",
}
_CONTENT = {"article", "main"}
_AROUND = {"nav", "aside", "form", "menu", "dialog", "button", "head"}
_OUTSIDE_ARTICLE = {"header", "footer"}
# Words of class, id and role attributes that name what is not the article.
_MARKS = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "adsense", "alert", "banner", "breadcrumb",
    "breadcrumbs", "comment", "comments", "commentlist", "complementary", "consent", "contentinfo", "cookie", "cookies", "disqus", "footer", "gdpr",
    "masthead", "menu", "menubar", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notices",
    "pagination", "popup", "promo", "promoted", "promotion", "related", "replies", "respond", "search", "share",
    "sharing", "sidebar", "sitemap", "social", "sponsor", "sponsored", "subscribe", "toolbar", "topbar", "widget",
}
_MARKS_OUTSIDE_ARTICLE = {"header"}
# Parts of such names that say where or how; any other part makes it a name of something else.
_PLACES = {
    "area", "bar", "block", "bottom", "box", "buttons", "col", "column", "container", "content", "form", "global",
    "group", "home", "icons", "inner", "item", "items", "left", "links", "list", "main", "media", "outer", "page",
    "panel", "posts", "primary", "right", "row", "secondary", "section", "site", "slot", "sticky", "text", "thread",
    "title", "top", "unit", "wrap", "wrapper",
}
# First parts of names that say what something has or hasn't, not what it is.
_ABOUT = {"has", "is", "no", "not", "with", "without"}
# Marks that count on an article element itself.
_READERS = {"comment", "comments", "commentlist", "replies", "respond"}

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*+)(?:>|\Z)",
    re.DOTALL,
)
# One attribute after the other, with its value: what stands in a value is no name.
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"?|'([^']*)'?|([^\s"'>][^\s>]*)))?""")
_PART = re.compile(r"[^a-z0-9]+")
_CLOSED_BY_BLOCK = {"p", "li", "dt", "dd", "option", "tr", "td", "th"}

KEEP, DROP, UNSURE = 1, 2, 0


def _marked(name: str, attributes: str, in_article: bool) -> bool:
    """The element's name or attributes say that it isn't the article."""
    if name in _AROUND or (name in _OUTSIDE_ARTICLE and not in_article):
        return True
    if not attributes:
        return False
    for m in _ATTRIBUTE.finditer(attributes):
        key = m[1].lower()
        value = (m[2] or m[3] or m[4] or "").lower()
        if key == "hidden":
            return True
        if key == "aria-hidden" and value == "true":
            return True
        if key == "style":
            if re.search(r"display\s*:\s*none", value):
                return True
        elif name not in ("body", "html") and key in ("class", "id", "role"):
            marks = _READERS if name in _CONTENT else _MARKS
            if not in_article and name not in _CONTENT:
                marks = marks | _MARKS_OUTSIDE_ARTICLE
            for entry in value.split():
                parts = [x for x in _PART.split(entry) if x]
                rest = {x for x in parts if x not in marks and not x.isdigit()}
                if len(rest) < len(set(parts)) and parts[0] not in _ABOUT and rest <= _PLACES | _MARKS:
                    return True
    return False


def text_lines(page: str | None) -> list[tuple[str, int]]:
    """Blocks of text in page order, each with KEEP (in an article), DROP (menus and so on) or UNSURE.

    Scripts, styles, comments and markup are gone, character references decoded,
    white space inside a block is one space. Elements left open end with the
    element around them, an unfinished tag with the page.
    """
    if not page:
        return []
    lines: list[tuple[str, int]] = []
    stack: list[tuple[str, bool, bool]] = []  # name, makes it dropped, makes it content
    pieces: list[str] = []
    dropped = content = 0
    at, n = 0, len(page)

    def close() -> None:
        if pieces:
            text = " ".join("".join(pieces).split())
            pieces.clear()
            if text:
                lines.append((text, DROP if dropped else KEEP if content else UNSURE))

    def add(raw: str) -> None:
        pieces.append(html.unescape(raw) if "&" in raw else raw)

    while at < n:
        m = _TAG.search(page, at)
        if m is None:
            add(page[at:])
            break
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            if m[0].startswith("<![CDATA["):
                add(m[0][9:].removesuffix("]]>"))
            continue
        closing, attributes = bool(m[1] or m[4]), m[3] or m[6] or ""
        if name in _RAW and not closing:
            if not attributes.endswith("/") or name in ("script", "style", "textarea", "title"):
                end = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>?", re.I).search(page, at)
                if name not in ("script", "style", "title"):
                    close()
                at = end.end() if end else n
            continue
        if name not in _INLINE:
            close()
        if name in _VOID:
            continue
        if closing:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    # text markup ends alone, other elements end all that is open inside them
                    ended = slice(k, k + 1 if name in _INLINE else None)
                    if any(was_dropped for _, was_dropped, _ in stack[ended]):
                        close()
                    for _, was_dropped, was_content in stack[ended]:
                        dropped -= was_dropped
                        content -= was_content
                    del stack[ended]
                    break
            continue
        if name not in _INLINE and stack and stack[-1][0] in _CLOSED_BY_BLOCK and (
            stack[-1][0] == name or (stack[-1][0] == "p" and name != "p")
        ):
            _, was_dropped, was_content = stack.pop()
            dropped -= was_dropped
            content -= was_content
        if attributes.endswith("/") and name in _INLINE:
            continue
        is_dropped, is_content = _marked(name, attributes, content > 0), name in _CONTENT
        if is_dropped and name in _INLINE:
            close()
        dropped += is_dropped
        content += is_content
        stack.append((name, is_dropped, is_content))
    close()
    return lines


def shared_lines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which entries of ``a`` belong to a longest common subsequence of ``a`` and ``b``."""
    shared = np.zeros(len(a), bool)
    _align(a, b, np.arange(len(a)), shared)
    return shared


# Entries in one table of bits; a larger pair is halved first.
_CELLS = 1 << 26


def _align(a: np.ndarray, b: np.ndarray, at: np.ndarray, shared: np.ndarray) -> None:
    keep = np.isin(a, b)
    a, at, b = a[keep], at[keep], b[np.isin(b, a)]
    if not len(a) or not len(b):
        return
    k = min(len(a), len(b))
    differ = np.flatnonzero(a[:k] != b[:k])
    same = int(differ[0]) if len(differ) else k
    shared[at[:same]] = True
    a, b, at = a[same:], b[same:], at[same:]
    k = min(len(a), len(b))
    if not k:
        return
    differ = np.flatnonzero(a[::-1][:k] != b[::-1][:k])
    same = int(differ[0]) if len(differ) else k
    shared[at[len(at) - same :]] = True
    a, b, at = a[: len(a) - same], b[: len(b) - same], at[: len(at) - same]
    if not len(a) or not len(b):
        return
    if len(a) * len(b) > _CELLS and len(a) > 1:
        middle = len(a) // 2
        ahead = _lengths(a[:middle], b)
        back = _lengths(a[middle:][::-1], b[::-1])[::-1]
        cut = int(np.argmax(ahead + back))
        _align(a[:middle], b[:cut], at[:middle], shared)
        _align(a[middle:], b[cut:], at[middle:], shared)
        return
    rows = _bit_rows(a, b)
    i, j = len(a), len(b)
    while i and j:
        # a zero bit: the common subsequence grows at this entry of b
        if (rows[i] >> (j - 1)) & 1:
            j -= 1
        elif not (rows[i - 1] >> (j - 1)) & 1:
            i -= 1
        else:
            shared[at[i - 1]] = True
            i, j = i - 1, j - 1


def _bit_rows(a: np.ndarray, b: np.ndarray) -> list[int]:
    """After each entry of ``a``, one bit per entry of ``b``: zero where the common subsequence grows."""
    places: dict[int, int] = {}
    for j, x in enumerate(b.tolist()):
        places[x] = places.get(x, 0) | (1 << j)
    full = (1 << len(b)) - 1
    rows = [full]
    for x in a.tolist():
        v = rows[-1]
        u = v & places.get(x, 0)
        rows.append(((v + u) | (v - u)) & full)
    return rows


def _lengths(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the longest common subsequence of ``a`` with every beginning of ``b``."""
    places: dict[int, int] = {}
    for j, x in enumerate(b.tolist()):
        places[x] = places.get(x, 0) | (1 << j)
    full = (1 << len(b)) - 1
    v = full
    for x in a.tolist():
        u = v & places.get(x, 0)
        v = ((v + u) | (v - u)) & full
    bits = np.unpackbits(np.frombuffer((v ^ full).to_bytes(len(b) // 8 + 1, "little"), np.uint8), bitorder="little")
    return np.concatenate(([0], np.cumsum(bits[: len(b)])))


def host_of(url: Column) -> Column:
    """What follows ``://`` up to ``/ ? #``, A-Z in lower case; empty if there is none."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host up to ``? #``; empty if there is no ``://``."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def _fingerprint(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode(), digest_size=8).digest(), "little", signed=True)


def _parsed(pages: DataFrame) -> DataFrame:
    """(page_id, url, key, hashes, blob): line fingerprints, and the lines with their kinds, packed."""

    def work(columns):
        hashes, blobs, keys = [], [], []
        for page in columns["html"].to_pylist():
            lines = text_lines(page)
            hashes.append([_fingerprint(text) for text, _ in lines])
            packed = "\n".join(f"{kind}{text}" for text, kind in lines).encode()
            blobs.append(zlib.compress(packed, 1))
            keys.append(_fingerprint(page or ""))
        return {
            "key": pa.array(keys, pa.int64()),
            "hashes": pa.array(hashes, pa.list_(pa.int64())),
            "blob": pa.array(blobs, pa.binary()),
        }

    return add_columns(pages, ["html"], ["page_id", "url"], "key long, hashes array<long>, blob binary", work)


def _common_start(a: Column, b: Column) -> Column:
    """Number of characters that two paths have in common at the start."""
    length = F.least(F.length(a), F.length(b))
    differ = F.filter(F.sequence(F.lit(1), length), lambda k: F.substr(a, k, F.lit(1)) != F.substr(b, k, F.lit(1)))
    return F.when((length > 0), F.coalesce(F.get(differ, F.lit(0)) - 1, length)).otherwise(0)


def page_texts(pages: DataFrame) -> DataFrame:
    """Main text of web pages (page_id, url, html): page_id, url, text and what decided it, a row for each row.

    ``lines`` counts a page's lines, ``shared`` those that alignment proposes to
    delete, ``restored`` those of them that stay since they stand in an article,
    ``marked`` those that only the markup deletes. The library's own records have
    no pages, so this is for any table of them. Pages of a host with all the same
    lines (copies, other queries of one path) are one page, that of the smallest
    address, so that none deletes the other's text. A page without another one on
    its host has no partner and is judged by its markup alone. A null or empty page
    has an empty text; repeated rows get equal results. Line fingerprints have 64
    bits. Only the fingerprints of lines are put in order by address; the texts
    themselves move once, packed.
    """
    host, lines = host_of(F.col("url")), F.xxhash64("hashes", F.size("hashes"))
    parsed = _parsed(pages).withColumn("host", host).withColumn("same", lines)
    place = F.struct(path_of(F.col("url")).alias("path"), "url", "hashes")
    small = parsed.groupBy("host", "same").agg(F.min(place).alias("p")).select("host", "same", "p.*")
    ordered = small.repartitionByRange("host", "path", "url", "same").sortWithinPartitions("host", "path", "url", "same")
    ordered = ordered.withColumn("_at", F.monotonically_increasing_id())
    beside = F.struct("path", "hashes")
    met = neighbours(
        ordered.select("same", "host", "path", "hashes", "_at"),
        ["host"],
        ["_at"],
        F.shiftright("_at", 33),
        lag={"before": (beside, 1)},
        lead={"after": (beside, 1)},
    )
    first, second = _common_start(F.col("path"), F.col("before.path")), _common_start(F.col("path"), F.col("after.path"))
    nearest = F.when(F.col("after").isNull() | (first >= second), F.col("before.hashes")).otherwise(F.col("after.hashes"))
    partner = met.select("host", "same", F.coalesce(nearest, F.col("after.hashes")).alias("beside"), "hashes")

    def align(columns):
        shared = []
        for own, other in zip(columns["hashes"].to_pylist(), columns["beside"].to_pylist(), strict=True):
            same = shared_lines(np.array(own or [], np.int64), np.array(other or [], np.int64))
            shared.append(np.flatnonzero(same).tolist())
        return {"repeated": pa.array(shared, pa.list_(pa.int32()))}

    found = add_columns(partner, ["hashes", "beside"], ["host", "same"], "repeated array<int>", align)
    rows = parsed.select("page_id", "url", "host", "same", "blob").join(found, ["host", "same"], "left")

    def write(columns):
        texts, counts = [], []
        for blob, repeated in zip(columns["blob"].to_pylist(), columns["repeated"].to_pylist(), strict=True):
            lines = [x for x in zlib.decompress(blob).decode().split("\n") if x] if blob else []
            kinds = np.array([int(x[0]) for x in lines], int)
            shared = np.zeros(len(lines), bool)
            shared[repeated or []] = True
            # first what alignment proposes, then what the markup has against it
            goes = shared & (kinds != KEEP)
            marked = ~shared & (kinds == DROP)
            texts.append(" ".join(lines[k][1:] for k in np.flatnonzero(~goes & ~marked)))
            counts.append((len(lines), shared.sum(), (shared & (kinds == KEEP)).sum(), marked.sum()))
        numbers = np.array(counts, np.int64).reshape(-1, 4).T
        return {"text": pa.array(texts, pa.string())} | {
            name: pa.array(n) for name, n in zip(("lines", "shared", "restored", "marked"), numbers, strict=True)
        }

    adds = "text string, lines long, shared long, restored long, marked long"
    return add_columns(rows, ["blob", "repeated"], ["page_id", "url"], adds, write)
