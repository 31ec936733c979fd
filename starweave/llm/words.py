"""Whole texts to token ids through their distinct words.

Words repeat, so a text is split at spaces, and a worker encodes a word once and remembers its ids;
a text's ids are its words' ids put together. A split is taken only where no token can span it; a
text that holds a space before other white space is encoded as a whole.
"""

from __future__ import annotations

import json
import sys
from array import array
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc

#: White space beside the plain space, as a class for RE2. Fixed values.
SPACES = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"

#: Words a worker remembers; the memory is emptied when full, so it is bounded.
REMEMBERED = 700_000


class Remembered(dict):
    """Ids of words as bytes (little-endian unsigned 32-bit), found by `encode` when first asked for."""

    def __init__(self, encode, most: int = REMEMBERED):
        super().__init__()
        self.encode, self.most = encode, most

    def __missing__(self, word):
        if len(self) >= self.most:
            self.clear()
        out = packed(self.encode(word))
        if len(word) < 64:
            self[word] = out
        return out


def packed(ids: list[int]) -> bytes:
    """Little-endian unsigned 32-bit."""
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


class ByteBpe:
    """Ids as the tokenizers library gives them for a byte-level BPE file; special strings count as special."""

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec["pre_tokenizer"] or {}
        plain = model["type"] == "BPE" and not model.get("dropout") and not model.get("ignore_merges") and spec["normalizer"] is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
        if not plain:
            raise ValueError("a byte-level BPE file without a normalizer is needed")
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.tokenizer = Tokenizer.from_file(path)
        back = {chr(b): b for b in [*range(33, 127), *range(161, 173), *range(174, 256)]}
        back |= {chr(256 + k): b for k, b in enumerate(b for b in range(256) if chr(b) not in back)}
        ranks = {bytes(back[c] for c in word): i for word, i in model["vocab"].items() if word not in self.special}
        # Ids serve as merge order only where the file's merges come in the order of their results' ids.
        made = [model["vocab"]["".join(m) if isinstance(m, list) else m.replace(" ", "")] for m in model["merges"]]
        self.encoding = tiktoken.Encoding("words", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}) if made == sorted(made) else None
        self.bare, self.spaced = Remembered(self.one), Remembered(lambda word: self.one(" " + word))

    def one(self, chunk: str) -> list[int]:
        if self.encoding is None or any(s in chunk for s in self.special):
            return self.tokenizer.encode(chunk, add_special_tokens=False).ids
        try:
            return self.encoding._core_bpe.encode_ordinary(chunk)
        except BaseException as e:  # the pattern's engine panics on very long runs of spaces
            if type(e).__name__ != "PanicException":
                raise
            return self.tokenizer.encode(chunk, add_special_tokens=False).ids

    def forget(self) -> None:
        self.bare.clear()
        self.spaced.clear()

    def batch(self, col: pa.Array) -> list[bytes]:
        """Each text's ids, as packed() has them."""
        whole = pc.match_substring_regex(col, " " + SPACES)
        for s in self.special:
            whole = pc.or_(whole, pc.match_substring(col, s))
        bare, spaced, out = self.bare, self.spaced.__getitem__, []
        for text, at_once in zip(col.to_numpy(zero_copy_only=False), whole.to_numpy(zero_copy_only=False), strict=True):
            if at_once:
                out.append(packed(self.one(text)))
            else:
                words = text.split(" ")
                out.append(b"".join([bare[words[0]], *map(spaced, words[1:])]))
        return out


#: How byte-level BPE cuts a text before merging. Fixed value.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=4)
def byte_bpe(path: str) -> ByteBpe:
    return ByteBpe(path)


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
