"""SentencePiece encoding and decoding of transcripts by vectorised merge rounds.

The distinct words of many texts lie in one flat array of symbols. In every
round each word merges its best pair: the one of smallest rank, found as a
segmented minimum, at its leftmost place, and at all other places that do not
overlap if no merge with the new piece could come before; then the array is
compacted. A word with no pair left is done. Words end where a space begins,
which no piece crosses.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from cuemill.llm.batches import add_columns
from cuemill.llm.words import fingerprints

# The character that stands for a space, and what an unknown piece is written as.
SPACE = 0x2581
UNKNOWN = " ⁇ "
_NONE = np.int32(2**31 - 1)
# Characters encoded at once; a longer single text is worked on whole.
_CHARS = 500_000
_SECOND_BASE = 0xC2B2AE3D27D4EB4F


@dataclass
class PieceTables:
    """Flat tables of a piece model."""

    of_char: np.ndarray  # piece of a character, -1 if there is none
    pairs: np.ndarray  # sorted keys left * 2^32 + right
    merged: np.ndarray  # piece that a pair makes
    rank: np.ndarray  # of a piece: smaller is merged first; equal where scores are equal
    alone: np.ndarray  # merges of this piece must be made one at a time
    of_byte: np.ndarray  # piece of a byte
    data: np.ndarray  # what pieces decode to, one after the other
    at: np.ndarray
    leading: np.ndarray  # piece begins with a space
    control: np.ndarray

    def look_up(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Pieces made of pairs of pieces, -1 where there is none."""
        key = (left.astype(np.int64) << 32) | right.astype(np.int64)
        at = np.searchsorted(self.pairs, key).clip(max=max(len(self.pairs) - 1, 0))
        good = (left >= 0) & (right >= 0)
        if not len(self.pairs):
            return np.full(len(key), -1, np.int32)
        return np.where(good & (self.pairs[at] == key), self.merged[at], -1).astype(np.int32)


def load_pieces(path: str) -> PieceTables:
    """Tables of a byte-pair model with byte pieces, a space put before every text, and no text changed.

    Raises ValueError for a model of another kind.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    probe = " ﬁ Å  x"
    if model.decode(model.encode(probe)) != probe or model.encode("a") != model.encode("a", add_bos=False):
        raise ValueError("only models that leave text as it is are supported")
    n = model.get_piece_size()
    names = [model.id_to_piece(i) for i in range(n)]
    kinds = [(model.is_byte(i), model.is_control(i), model.is_unknown(i), model.is_unused(i)) for i in range(n)]
    if sum(k[0] for k in kinds) != 256 or any(k[3] for k in kinds):
        raise ValueError("only models with byte pieces and without unused ones are supported")
    own = {p: i for i, (p, k) in enumerate(zip(names, kinds, strict=True)) if not any(k)}
    space = chr(SPACE)
    if any(c not in own for p in own for c in p) or any(space in p.lstrip(space) for p in own):
        raise ValueError("pieces must be made of character pieces and hold spaces only in front")
    scores = np.array([model.get_score(i) for i in range(n)])
    rank = np.unique(-scores, return_inverse=True)[1].astype(np.int32)
    table: dict[int, int] = {}
    alone = np.zeros(n, bool)
    alone[[i for i, c in enumerate(np.bincount(rank)[rank]) if c > 1]] = True
    for piece, i in own.items():
        for k in range(1, len(piece)):
            left, right = own.get(piece[:k]), own.get(piece[k:])
            if left is not None and right is not None:
                table[(left << 32) | right] = i
                for part in (left, right):
                    alone[part] |= rank[i] <= rank[part]
    keys = np.array(sorted(table), np.int64)
    of_char = np.full(0x110000, -1, np.int32)
    for piece, i in own.items():
        if len(piece) == 1:
            of_char[ord(piece)] = i
    of_byte = np.zeros(256, np.int32)
    written = []
    for i, (name, (byte, control, unknown, _)) in enumerate(zip(names, kinds, strict=True)):
        if byte:
            of_byte[int(name[1:-1], 16)] = i
            written.append(bytes([int(name[1:-1], 16)]))
        else:
            text = "" if control else UNKNOWN if unknown else name.replace(space, " ")
            written.append(text.encode())
    return PieceTables(
        of_char,
        keys,
        np.array([table[k] for k in keys.tolist()], np.int32),
        rank,
        alone,
        of_byte,
        np.frombuffer(b"".join(written), np.uint8),
        np.concatenate(([0], np.cumsum([len(w) for w in written]))).astype(np.int64),
        np.isin(np.arange(n), [i for p, i in own.items() if p.startswith(space)]),
        np.array([k[1] for k in kinds]),
    )


def _gather(at: np.ndarray, pick: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the entries of the lists ``pick`` (list i: at[i] to at[i + 1]), and where each list then begins."""
    size = at[pick + 1] - at[pick]
    begin = np.concatenate(([0], np.cumsum(size)))
    return np.repeat(at[pick] - begin[:-1], size) + np.arange(begin[-1]), begin


def merge_words(symbols: np.ndarray, at: np.ndarray, t: PieceTables) -> tuple[np.ndarray, np.ndarray]:
    """Pieces of words given as character symbols (negative: no piece), word i at[i] to at[i + 1]; the same shape."""
    n = len(at) - 1
    sym, word = symbols.astype(np.int32), np.repeat(np.arange(n), np.diff(at))
    done_sym, done_word = [], []
    made = np.full(len(sym), -1, np.int32)
    if len(sym) > 1:
        made[:-1] = np.where(word[:-1] == word[1:], t.look_up(sym[:-1], sym[1:]), -1)
    while len(sym):
        order = np.where(made >= 0, t.rank[made], _NONE)
        first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
        least = np.minimum.reduceat(order, first)
        size = np.diff(np.append(first, len(sym)))
        least = np.repeat(least, size)
        over = least == _NONE
        if over.any():
            done_sym.append(sym[over])
            done_word.append(word[over])
            live = ~over
            sym, word, made, order, least = sym[live], word[live], made[live], order[live], least[live]
            if not len(sym):
                break
        place = np.flatnonzero(order == least)
        # one merge only: the first of its word; otherwise every other one of a chain of overlapping places
        lead = np.concatenate(([True], word[place[1:]] != word[place[:-1]]))
        chain = np.concatenate(([True], (place[1:] != place[:-1] + 1) | lead[1:]))
        begin = np.maximum.accumulate(np.where(chain, np.arange(len(place)), 0))
        even = (np.arange(len(place)) - begin) % 2 == 0
        single = t.alone[made[place]]
        # a word with a pair to be merged alone merges only its first place
        group = np.cumsum(lead) - 1
        hold = np.bincount(group, single)[group] > 0
        place = place[np.where(hold, lead, even)]
        sym[place] = made[place]
        keep = np.ones(len(sym), bool)
        keep[place + 1] = False
        new = (np.cumsum(keep) - 1)[place]
        sym, word, made = sym[keep], word[keep], made[keep]
        # the pair after each merge and the one before it have changed
        for k in (new, new[new > 0] - 1):
            nxt = np.minimum(k + 1, len(sym) - 1)
            inside = (k + 1 < len(sym)) & (word[k] == word[nxt])
            made[k] = np.where(inside, t.look_up(sym[k], sym[nxt]), -1)
    out, owner = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (done_sym, done_word))
    by = np.argsort(owner, kind="stable")
    return out[by], np.concatenate(([0], np.cumsum(np.bincount(owner.astype(np.int64), minlength=n)))).astype(np.int64)


def _spell(sym: np.ndarray, at: np.ndarray, t: PieceTables) -> tuple[np.ndarray, np.ndarray]:
    """Characters without a piece become the pieces of their UTF-8 bytes."""
    odd = np.flatnonzero(sym < 0)
    if not len(odd):
        return sym, at
    size = np.ones(len(sym), np.int64)
    raw = [chr(-1 - int(c)).encode() for c in sym[odd]]
    size[odd] = [len(r) for r in raw]
    begin = np.concatenate(([0], np.cumsum(size)))
    out = np.repeat(sym, size)
    for k, r in zip(begin[odd].tolist(), raw, strict=True):
        out[k : k + len(r)] = t.of_byte[list(r)]
    return out, begin[at]


def encode_texts(texts: list[str | None], t: PieceTables) -> tuple[np.ndarray, np.ndarray]:
    """Piece ids of all texts, one after the other, and where each begins."""
    size = np.array([len(x) + 1 if x else 0 for x in texts], np.int64)
    at = np.concatenate(([0], np.cumsum(size)))
    chars = np.frombuffer("".join(" " + x for x in texts if x).encode("utf-32-le"), np.uint32)
    chars = np.where(chars == 32, np.uint32(SPACE), chars)
    if not len(chars):
        return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
    space = chars == SPACE
    start = space & ~np.concatenate(([False], space[:-1]))
    start[at[:-1][size > 0]] = True
    first = np.flatnonzero(start)
    past = np.append(first[1:], len(chars))
    keys = fingerprints(chars, first, past)
    _, sample, of = np.unique(keys, return_index=True, return_inverse=True)
    # a second fingerprint tells words apart that the first one confuses
    other = fingerprints(chars, first, past, _SECOND_BASE)
    if (other[sample][of] != other).any():
        both = np.rec.fromarrays([keys, other])
        _, sample, of = np.unique(both, return_index=True, return_inverse=True)
    bounds = np.concatenate((first, [len(chars)]))
    place, word_at = _gather(bounds, sample)
    letters = chars[place]
    symbols = t.of_char[letters]
    symbols = np.where(symbols >= 0, symbols, -1 - letters.astype(np.int32))
    ids, ids_at = _spell(*merge_words(symbols, word_at, t), t)
    place, begin = _gather(ids_at, of)
    return ids[place].astype(np.int32), begin[np.searchsorted(first, at)]


def decode_ids(ids: np.ndarray, at: np.ndarray, t: PieceTables) -> list[str]:
    """Texts of lists of piece ids, list i at[i] to at[i + 1]."""
    place, begin = _gather(t.at, ids)
    data = t.data[place].tobytes()
    begin = begin[at]
    lead = np.zeros(len(at) - 1, np.int64)
    for k in np.flatnonzero(np.diff(at)).tolist():
        j = at[k]
        while j < at[k + 1] and t.control[ids[j]]:
            j += 1
        lead[k] = j < at[k + 1] and t.leading[ids[j]]
    low = (begin[:-1] + lead).tolist()
    return [data[a:b].decode("utf-8", "replace") for a, b in zip(low, begin[1:].tolist(), strict=True)]


def _lists(ids: np.ndarray, at: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids))


def encode_transcripts(
    transcripts: DataFrame, pieces: PieceTables, keep: tuple[str, ...] = ("media_id",), decoded: bool = False
) -> DataFrame:
    """``keep`` columns of transcripts (text) with token_ids: the piece ids of the whole text.

    The ids are those that the sentencepiece library gives for the model, without
    begin and end pieces. A null or empty text has no ids. With ``decoded``, a
    column of that name holds what the ids decode to, as a check of the round
    trip without another pass. Rows stay rows.
    """
    shared = transcripts.sparkSession.sparkContext.broadcast(pieces)

    def work(columns):
        texts = columns["text"].to_pylist()
        parts, sizes, written, held, k = [], [], [], 0, 0
        for i, text in enumerate(texts):
            held += len(text or "")
            if held >= _CHARS or i + 1 == len(texts):
                ids, at = encode_texts(texts[k : i + 1], shared.value)
                parts.append(ids)
                sizes.append(np.diff(at))
                if decoded:
                    written += decode_ids(ids, at, shared.value)
                held, k = 0, i + 1
        at = np.concatenate(([0], np.cumsum(np.concatenate(sizes))))
        made = {"token_ids": _lists(np.concatenate(parts), at)}
        return made | {"decoded": pa.array(written, pa.string())} if decoded else made

    return add_columns(
        transcripts, ["text"], keep, "token_ids array<int>" + ", decoded string" * decoded, work
    )


def decode_transcripts(encoded: DataFrame, pieces: PieceTables, keep: tuple[str, ...] = ("media_id",)) -> DataFrame:
    """``keep`` columns of encoded transcripts (token_ids) with their text.

    Spaces that stand for the one put before a text go, bytes that are not
    UTF-8 become U+FFFD, begin and end pieces are nothing. Null or no ids: an
    empty text; a null id is left out; an id outside the model raises IndexError.
    """
    shared = encoded.sparkSession.sparkContext.broadcast(pieces)

    def work(columns):
        lists = columns["token_ids"]
        at = np.concatenate(([0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy()))).astype(np.int64)
        flat = lists.flatten()
        if flat.null_count:
            real = flat.is_valid().to_numpy(zero_copy_only=False)
            at = np.concatenate(([0], np.cumsum(real)))[at]
            flat = flat.drop_null()
        ids = flat.to_numpy(zero_copy_only=False).astype(np.int64)
        if len(ids) and ids.min() < 0:
            raise IndexError("piece ids are not negative")
        return {"text": pa.array(decode_ids(ids, at, shared.value), pa.string())}

    return add_columns(encoded, ["token_ids"], keep, "text string", work)
