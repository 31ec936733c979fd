"""Token counts by the whole-token shortcut.

Offline, each vocabulary string shaped like a word is encoded alone; those that come back as one token
are proven, and a word found among them counts as one without any merging. Only other words are merged,
by the library, and remembered. Splitting at single spaces is exact because no piece holds a space mark
after another character, which is checked when the model is loaded; texts with runs of spaces, a leading
space or the mark itself are encoded as a whole.

Null and empty texts have 0 bytes and 0 tokens; repeated rows each give a row; an empty table gives none.
Only doc_id and text are read, so further columns never clash.
"""

from __future__ import annotations

from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .shared import joined, slices, texts

MARK = "▁"
REMEMBERED = 1_000_000


def proven(processor) -> dict[str, int]:
    """Words (without the mark) whose marked form encodes alone as one token."""
    words = {p[1:]: i for i in range(processor.get_piece_size()) if (p := processor.id_to_piece(i))[0] == MARK and len(p) > 1 and MARK not in p[1:] and not processor.is_control(i)}
    return {w: 1 for (w, i), ids in zip(words.items(), processor.encode(list(words), num_threads=1), strict=True) if ids == [i]}


def separable(processor) -> bool:
    """Whether tokens never span the border before a space mark, and texts are taken as they are."""
    pieces = (processor.id_to_piece(i) for i in range(processor.get_piece_size()))
    probe = "ﬁ Ａ\t　x\xa0 y"
    return not any(MARK in p.lstrip(MARK) for p in pieces) and processor.decode(processor.encode(probe)) == probe and processor.encode("a b") == processor.encode("a") + processor.encode("b")


class WordCounts(dict):
    """Tokens of each word; starts from the proven ones and falls back to them when full."""

    def __init__(self, processor):
        self.processor, self.sure = processor, proven(processor)
        super().__init__(self.sure)

    def __missing__(self, word: str) -> int:
        n = len(self.processor.encode(word))
        if len(word) < 64:
            if len(self) >= REMEMBERED:
                self.clear()
                self.update(self.sure)
            self[word] = n
        return n


class Counter:
    def __init__(self, path: str):
        import sentencepiece

        self.processor = sentencepiece.SentencePieceProcessor(model_file=path)
        self.separable = separable(self.processor)
        self.words = WordCounts(self.processor)

    def batch(self, col: pa.Array) -> list[int]:
        whole = pc.or_(pc.match_substring_regex(col, f"^ |  | $|{MARK}"), pc.equal(pc.binary_length(col), 0))
        of, out = self.words.__getitem__, []
        for text, at_once in zip(col.to_numpy(zero_copy_only=False), whole.to_numpy(zero_copy_only=False), strict=True):
            if at_once or not self.separable:
                out.append(len(self.processor.encode(text)))
            else:
                out.append(sum(map(of, text.split(" "))))
        return out


@lru_cache(maxsize=4)
def counter(path: str) -> Counter:
    return Counter(path)


def count_tokens(docs: DataFrame, path: str, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row of docs(doc_id, text)."""
    ids = docs.schema["doc_id"].dataType.simpleString()

    def count(batches):
        own, schema = counter(path), None
        for b in slices(batches):
            n = pa.array(own.batch(b.column(1)), type=pa.int64())
            schema = schema or pa.schema([("doc_id", b.column(0).type), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])
            yield joined(schema, [b.column(0), pc.binary_length(b.column(1)).cast(pa.int64()), n, pc.greater(n, limit)])

    return texts(docs).mapInArrow(count, f"doc_id {ids}, n_bytes long, n_tokens long, over_limit boolean")
