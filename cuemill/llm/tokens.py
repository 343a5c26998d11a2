"""Token ids of texts by a byte-level BPE file of the tokenizers library."""

from __future__ import annotations

import json
import re
from functools import cached_property

import numpy as np

# Fixed value: how byte-level BPE splits a text before merging.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# Latin letters and general punctuation: old characters, on whose kinds all libraries agree.
_OTHER = re.compile("[^\x00-ɏ‐-‧‰-⁞]")


def _byte_of_char() -> dict[str, int]:
    """The printable stand-ins of bytes in a vocabulary file: themselves, the others counted up from 256."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Vocabulary:
    """What a tokenizers file holds, to be sent to tasks as text and loaded once in each.

    ``ids`` are those that the tokenizers library gives without special tokens
    around. Where the file is plain byte-level BPE whose ids are its merge order,
    texts of old characters are encoded by tiktoken, which merges the same pairs
    several times as fast; all other texts, also those that hold the name of a
    special token, are encoded by the tokenizers library itself.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            self.text = file.read()

    def __getstate__(self):
        return {"text": self.text}

    @cached_property
    def _exact(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_str(self.text)

    @cached_property
    def _special(self) -> list[str]:
        return [t["content"] for t in json.loads(self.text).get("added_tokens") or []]

    @cached_property
    def _ranks(self) -> dict[bytes, int] | None:
        """Rank of every token by its bytes, or None if the file isn't plain byte-level BPE."""
        spec = json.loads(self.text)
        model, before = spec["model"], spec.get("pre_tokenizer") or {}
        plain = (
            model.get("type") == "BPE"
            and before.get("type") == "ByteLevel"
            and before.get("use_regex")
            and not before.get("add_prefix_space")
            and not any([spec.get("normalizer"), spec.get("truncation"), spec.get("padding")])
            and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback"))
        )
        if not plain:
            return None
        pairs = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
        vocabulary = model["vocab"]
        if [vocabulary.get(p) for p in pairs] != list(range(256, 256 + len(pairs))):
            return None
        char, special = _byte_of_char(), set(self._special)
        return {bytes(char[c] for c in token): k for token, k in vocabulary.items() if token not in special}

    @cached_property
    def _fast(self):
        if self._ranks is None:
            return None
        import tiktoken

        return tiktoken.Encoding("byte-level", pat_str=SPLIT, mergeable_ranks=self._ranks, special_tokens={})

    def ids(self, text: str) -> np.ndarray:
        if self._fast is not None and not _OTHER.search(text) and not any(s in text for s in self._special):
            return self._fast.encode_to_numpy(text, disallowed_special=())
        return np.array(self._exact.encode(text, add_special_tokens=False).ids, np.uint32)
