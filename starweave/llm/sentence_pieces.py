"""SentencePiece encoding and decoding by a shared-prefix forward pass.

The distinct marked words of a batch are sorted, which lays them out as a trie in depth-first order:
a word keeps the forward states of the prefix it shares with the word before it and computes only the
rest. A state is the last piece of the best segmentation of a prefix.

* Unigram models: the state also holds the best score, the classic Viterbi recurrence.
* BPE models: a prefix's segmentation ends in the one piece that BPE leaves apart from the last piece of
  the shorter prefix's segmentation, so the same forward pass gives exactly what merging gives. Whether
  BPE leaves two pieces apart is decided by merging just these two, once for each pair.

Characters outside the vocabulary become byte pieces. Words are remembered between batches, in bounded
memory. Null and empty texts give no ids; texts with runs of spaces, leading or trailing spaces or the
mark itself are words too (runs of marks belong to the word after them). Repeated rows each give a row,
an empty table none; only doc_id and text are read.
"""

from __future__ import annotations

import re
import zlib
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .shared import joined, slices, texts
from .words import packed

MARK = "▁"
REMEMBERED = 700_000
#: How far below the worst score a character outside a unigram vocabulary lies. Fixed value.
UNKNOWN_PENALTY = 10.0


class Model:
    """Pieces and scores of a model file."""

    def __init__(self, path: str, kind: str = "bpe"):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.kind, n = kind, sp.get_piece_size()
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        self.bytes = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if sp.is_byte(i)}
        self.of_byte = {i: b for b, i in self.bytes.items()}
        self.unknown = sp.unk_id()
        usual = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.ids = {self.pieces[i]: i for i in usual}
        self.score = {self.pieces[i]: sp.get_score(i) for i in usual}
        self.longest = max(map(len, self.ids), default=1)
        self.least = min(self.score.values(), default=0.0) - UNKNOWN_PENALTY
        self.control = {i for i in range(n) if sp.is_control(i)}
        self.apart: dict[tuple[str, str], bool] = {}
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("pieces that span words are not supported")

    def merged(self, symbols: list[str]) -> list[str]:
        """BPE on its own: the best-scored neighbours merge first, the leftmost of equals."""
        symbols = list(symbols)
        while len(symbols) > 1:
            best, at = None, -1
            for k in range(len(symbols) - 1):
                s = self.score.get(symbols[k] + symbols[k + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, k
            if best is None:
                break
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
        return symbols

    def left_apart(self, a: str, b: str) -> bool:
        found = self.apart.get((a, b))
        if found is None:
            if len(self.apart) >= 4_000_000:
                self.apart.clear()
            found = self.apart[a, b] = self.merged(list(a + b)) == ([a, b] if a else [b])
        return found

    def encode_words(self, words: list[str]) -> dict[str, bytes]:
        """Ids of distinct marked words, packed."""
        out: dict[str, bytes] = {}
        last, score, before = [""], [0.0], ""
        score_of, longest, bpe = self.score, self.longest, self.kind == "bpe"
        for word in sorted(words):
            shared, most = 0, min(len(word), len(before))
            while shared < most and word[shared] == before[shared]:
                shared += 1
            del last[shared + 1 :], score[shared + 1 :]
            for k in range(shared + 1, len(word) + 1):
                if bpe:
                    for j in range(max(0, k - longest), k):
                        piece = word[j:k]
                        if piece in score_of and self.left_apart(last[j], piece):
                            break
                    else:
                        piece = word[k - 1]
                    last.append(piece)
                else:
                    best, piece = score[k - 1] + self.least, word[k - 1]
                    if piece in score_of:
                        best = score[k - 1] + score_of[piece]
                    for j in range(max(0, k - longest), k - 1):
                        if word[j:k] in score_of and score[j] + score_of[word[j:k]] > best:
                            best, piece = score[j] + score_of[word[j:k]], word[j:k]
                    last.append(piece)
                    score.append(best)
            ids: list[int] = []
            k = len(word)
            while k:
                piece = last[k]
                found = self.ids.get(piece)
                if found is not None:
                    ids.append(found)
                elif self.bytes:
                    ids.extend(self.bytes[b] for b in reversed(piece.encode()))
                else:
                    ids.append(self.unknown)
                k -= len(piece)
            ids.reverse()
            out[word], before = packed(ids), word
        return out

    def decode(self, ids) -> str:
        """The text of ids: pieces joined, byte pieces put together, marks as spaces, without the first one."""
        out, run = [], bytearray()
        for i in ids:
            if i in self.of_byte:
                run.append(self.of_byte[i])
                continue
            if run:
                out.append(run.decode("utf-8", "replace"))
                run.clear()
            if i not in self.control:
                out.append(self.pieces[i].replace(MARK, " "))
        if run:
            out.append(run.decode("utf-8", "replace"))
        text = "".join(out)
        return text[1:] if text.startswith(" ") else text


class Encoder:
    def __init__(self, path: str, kind: str):
        self.model, self.known = Model(path, kind), {}

    def batch(self, col: pa.Array) -> list[bytes]:
        """Each text's ids, packed."""
        plain = pc.invert(pc.match_substring_regex(col, f"^ |  | $|{MARK}"))
        rows = []
        for text, ok in zip(col.to_numpy(zero_copy_only=False), plain.to_numpy(zero_copy_only=False), strict=True):
            if not text:
                rows.append([])
            elif ok:
                rows.append(text.split(" "))
            else:  # marked words less their first mark
                rows.append([w[1:] for w in re.findall(f"{MARK}+[^{MARK}]*", MARK + text.replace(" ", MARK))])
        known = self.known
        new = {w for words in rows for w in words if w not in known}
        if len(known) + len(new) > REMEMBERED:
            known.clear()
            new = {w for words in rows for w in words}
        known.update((w[1:], ids) for w, ids in self.model.encode_words([MARK + w for w in new]).items())
        out = [b"".join(map(known.__getitem__, words)) for words in rows]
        for w in [w for w in new if len(w) > 64]:
            del known[w]
        return out


@lru_cache(maxsize=4)
def encoder(path: str, kind: str) -> Encoder:
    return Encoder(path, kind)


def encode(docs: DataFrame, path: str, kind: str = "bpe") -> DataFrame:
    """doc_id and ids (array of int) for every row of docs(doc_id, text)."""

    def run(batches):
        own = encoder(path, kind)
        for b in slices(batches):
            out = own.batch(b.column(1))
            ends = pa.array([0, *_ends(out)], type=pa.int32())
            ids = pa.ListArray.from_arrays(ends, pa.Array.from_buffers(pa.int32(), ends[-1].as_py(), [None, pa.py_buffer(b"".join(out))]))
            yield pa.RecordBatch.from_arrays([b.column(0), ids], names=["doc_id", "ids"])

    return texts(docs).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def _ends(chunks: list[bytes]):
    at = 0
    for c in chunks:
        at += len(c) >> 2
        yield at


def decode(encoded: DataFrame, path: str, kind: str = "bpe") -> DataFrame:
    """doc_id and text for rows of (doc_id, ids); null ids give null."""

    def run(batches):
        model = encoder(path, kind).model
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([None if x is None else model.decode(x) for x in b.column(1).to_pylist()], type=pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {encoded.schema['doc_id'].dataType.simpleString()}, text string")


def encoding_digests(docs: DataFrame, path: str, kind: str = "bpe") -> DataFrame:
    """Per document: doc_id, n_ids, ids_crc32 (of the little-endian unsigned 32-bit ids), round_trip (the ids decode to the text).

    The round trip decodes every document from its ids alone; a mark that a text holds itself comes back as a space.
    """

    def run(batches):
        own, schema = encoder(path, kind), None
        for b in slices(batches):
            col = b.column(1)
            out = own.batch(col)
            back = [own.model.decode(memoryview(x).cast("I")) == t.replace(MARK, " ") for x, t in zip(out, col.to_numpy(zero_copy_only=False), strict=True)]
            schema = schema or pa.schema([("doc_id", b.column(0).type), ("n_ids", pa.int64()), ("ids_crc32", pa.int64()), ("round_trip", pa.bool_())])
            yield joined(schema, [b.column(0), [len(x) >> 2 for x in out], [zlib.crc32(x) for x in out], back])

    return texts(docs).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_ids long, ids_crc32 long, round_trip boolean")
