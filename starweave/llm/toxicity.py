"""Toxicity by class-conditional Kneser-Ney models.

Two models, of toxic and of ordinary text, predict each letter of a word from up to seven symbols before it
(the space before the word included). Both discount their own counts and back off to the same shared
continuation counts, so a rare expression is judged by the parts it shares with others. A word's evidence
is the difference of its two log-likelihoods. A document is judged by the difference of its own two
log-likelihoods (all its words, repeated ones included) normalised by its number of letters, by its strongest
word, and by the evidence beyond ENOUGH of its distinct words, normalised by the root of its number of distinct
chunks between spaces; a logistic curve over the three, fitted on labelled rows that the counts have not seen,
turns them into a score.

Counts come from all labelled rows whose crc32(doc_id) mod 4 is 0 or 1, the curve from all with 3, and 2
is held out. Every string of letters keeps its own counts, whatever their number: counts are written, dealt by
the letters before the last one, and each counted string gets its evidence where its counts lie. A string that was
not counted has the evidence of the letters before its last one, as the shared probability stands in both
models and cancels; where these were not counted either it is 0. Workers look strings up in slices of at most
about SLICE strings, of which they hold HELD at a time. Labels are joined to texts by broadcast only while they
are few (a checked count), else by a shuffle.

Null and empty texts have no words and evidence 0. Repeated rows each give a row; of repeated labels the
largest counts; null labels are ignored. Without labels of both classes every score is 0. An empty table
gives no rows. Only doc_id, text and the labels' doc_id and toxic are read. A null doc_id has no labels and is
not held out.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .shared import drop_since, lean, materialize, parts, release, slices, written

ORDER = 8
#: Bits of a letter's code.
BITS = 7
DISCOUNT = 0.75
#: Strings are dealt by so many symbols before the last one; shared counts of strings no longer than this are
#: broadcast (at most SYMBOLS ** SHORT, whatever the corpus).
SHORT = 3
#: Rows of counts in one group, about.
GROUP = 100_000
#: Strings in one table of evidence, about, and tables that a worker holds (12 bytes a string).
SLICE = 1_000_000
HELD = 4
#: Labelled rows up to which they are broadcast (16 bytes each).
FEW = 2_000_000
#: Evidence of a word (natural logarithm) that chance alone often reaches.
ENOUGH = 2.0
#: What the curve takes, and its least and greatest value; BINS bins of each.
FEATURES = {"strongest": (0.0, 5.0), "beyond": (0.0, 5.0), "whole": (-1.0, 1.0)}
BINS = 50
REMEMBERED = 60_000
THRESHOLD = 0.3
#: White space above ASCII; of ASCII all but letters is white space, and all other code points count as letters. Fixed values.
SPACES = np.array([0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])
#: The space's symbol. Letters a to z are one symbol each; any other letter is a leading symbol and one
#: trailing symbol, or three for large code points, so that no two letters are taken for each other.
SPACE = 1
LEAD, TRAIL = 28, 78
PAIRS = 40 * 50
#: Symbols in all.
SYMBOLS = 128
#: Marks the symbols before the last in a table of evidence.
OTHER = 1 << 60


def strings_of(chunks: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Strings of the words of chunks (none of which holds a space): for each symbol and each word's end the longest string
    that predicts it, packed, its length and its word; then each word's chunk."""
    flat = np.frombuffer(f" {' '.join(chunks)} ".lower().encode("utf-32-le", "replace"), dtype=np.uint32).astype(np.int64)
    letter = ((flat >= 97) & (flat <= 122)) | (flat >= 128)
    far = np.flatnonzero(flat >= 128)
    letter[far[np.isin(flat[far], SPACES)]] = False
    start = np.flatnonzero(letter[1:] & ~letter[:-1]) + 1  # of words
    chunk = np.searchsorted(np.flatnonzero(flat == 32), start) - 1
    keep = letter.copy()  # one separator before each word and one at the end
    keep[start - 1] = True
    keep[-1] = True
    flat = symbols(np.where(letter, flat, 32)[keep])
    n = len(flat)
    key = flat.copy()
    for k in range(1, ORDER):
        key[k:] |= flat[:-k] << (BITS * k)
    space = flat == SPACE
    at = np.arange(n)
    before = np.maximum.accumulate(np.where(space, at, 0))
    before = np.concatenate(([0], before[:-1]))  # the last space before each symbol
    size = np.minimum(ORDER, at - before + 1)
    size, key = size[1:], key[1:]
    return key & ((np.int64(1) << (BITS * size)) - 1), size, np.cumsum(space)[:-1] - 1, chunk


def symbols(flat: np.ndarray) -> np.ndarray:
    """Symbols of code points, which are letters and spaces."""
    out = np.where(flat == 32, SPACE, flat - 95)
    other = np.flatnonzero(flat >= 128)
    if not len(other):
        return out
    c = flat[other] - 128
    size = np.ones(len(flat), dtype=np.int64)
    size[other] = np.where(c < PAIRS, 2, 4)
    end = np.cumsum(size)
    wide = np.zeros(int(end[-1]), dtype=np.int64)
    wide[end - 1] = out
    few, many = other[c < PAIRS], other[c >= PAIRS]
    x = flat[few] - 128
    wide[end[few] - 2], wide[end[few] - 1] = LEAD + x // 50, TRAIL + x % 50
    x = flat[many] - 128
    wide[end[many] - 4], wide[end[many] - 3], wide[end[many] - 2], wide[end[many] - 1] = LEAD + 40 + x // 125_000, TRAIL + x // 2500 % 50, TRAIL + x // 50 % 50, TRAIL + x % 50
    return wide


def held_out(doc_id: Column) -> Column:
    """crc32(doc_id) mod 4; a null doc_id counts as empty."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 4


def whole(key: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A string as one number."""
    return key | (size.astype(np.int64) << 56)


@lean
def _count(batches):
    """Counts of each string in toxic and ordinary text, a row for each string and task."""
    seen: list[Counter] = [Counter(), Counter()]
    total: list[list[np.ndarray]] = []

    def fold():
        for toxic, chunks in enumerate(seen):
            if chunks:
                key, size, word, chunk = strings_of(list(chunks))
                weight = np.fromiter(chunks.values(), dtype=np.int64, count=len(chunks))[chunk]
                both, back = np.unique(whole(key, size), return_inverse=True)
                n = np.bincount(back, weights=weight[word], minlength=len(both)).astype(np.int64)
                total.append([both, n * (toxic == 1), n * (toxic == 0)])
            chunks.clear()
        if len(total) > 1:
            both, back = np.unique(np.concatenate([t[0] for t in total]), return_inverse=True)
            total[:] = [[both, *(np.bincount(back, weights=np.concatenate([t[k] for t in total]), minlength=len(both)).astype(np.int64) for k in (1, 2))]]

    for b in slices(batches, limit=1 << 20):
        for text, toxic in zip(b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_pylist(), strict=True):
            seen[toxic].update(text.split(" "))
        if sum(map(len, seen)) > 50_000:
            fold()
    fold()
    for both, toxic, plain in total:
        for k in range(0, len(both), 100_000):
            s = slice(k, k + 100_000)
            yield pa.RecordBatch.from_arrays([pa.array(both[s] & ((1 << 56) - 1)), pa.array((both[s] >> 56).astype(np.int32)), pa.array(toxic[s]), pa.array(plain[s])], names=["key", "size", "toxic", "plain"])

class Sums:
    """Sums of columns by string."""

    def __init__(self, key: np.ndarray, size: np.ndarray, *columns: np.ndarray):
        self.keys, back = np.unique(whole(key, size), return_inverse=True)
        self.sums = np.stack([np.bincount(back, weights=c, minlength=len(self.keys)) for c in columns], 1)

    def of(self, key: np.ndarray, size: np.ndarray) -> np.ndarray:
        """A row for each string asked; zeros where it is not known."""
        found = np.zeros((len(key), self.sums.shape[1]))
        if len(self.keys):
            asked = whole(key, size)
            at = np.minimum(np.searchsorted(self.keys, asked), len(self.keys) - 1)
            hit = self.keys[at] == asked
            found[hit] = self.sums[at[hit]]
        return found


def string_evidence(top: tuple[np.ndarray, ...], shared: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Evidence of each counted string (key, size, toxic, plain), and of a string not counted with the same symbols before the last.

    shared: key, size and number of the continuation counts. Both must hold all strings that agree with a
    counted one in all symbols before the last.
    """
    key, size, *n = top
    low_key, low_size, low_n = shared
    low, low_ctx = Sums(low_key, low_size, low_n), Sums(low_key >> BITS, low_size - 1, low_n, np.ones(len(low_n)))
    p = np.full(len(key), 1.0 / SYMBOLS)
    for k in range(1, ORDER):  # shared: predict from k - 1 symbols
        at = np.flatnonzero(k < size)
        suffix, of = key[at] & ((np.int64(1) << (BITS * k)) - 1), np.full(len(at), k, dtype=np.int64)
        seen = low.of(suffix, of)[:, 0]
        total, kinds = low_ctx.of(suffix >> BITS, of - 1).T
        new = (np.maximum(seen - DISCOUNT, 0) + DISCOUNT * kinds * p[at]) / np.maximum(total, 1)
        p[at] = np.where(total > 0, new, p[at])
    ctx = Sums(key >> BITS, size - 1, *n, *(c > 0 for c in n)).of(key >> BITS, size - 1)
    found, others = np.zeros(len(key)), np.zeros(len(key))
    for c, sign in ((0, 1), (1, -1)):
        total, kinds = ctx[:, c], ctx[:, 2 + c]
        there, back = total > 0, DISCOUNT * kinds / np.maximum(total, 1)
        q = np.where(there, np.maximum(n[c] - DISCOUNT, 0) / np.maximum(total, 1) + back * p, p)
        found += sign * np.log(np.maximum(q, 1e-12))
        others += sign * np.log(np.where(there, back, 1.0))
    return found, others


def strings(counts: DataFrame) -> DataFrame:
    """Evidence of each string of counts, by its number, and of strings not counted, by the symbols before the last, marked OTHER."""
    spark = counts.sparkSession
    spread = F.explode(F.expr(f"transform(sequence(2, greatest(size, 2)), n -> struct(n as size, key & (shiftleft(1L, {BITS} * n) - 1) as key))")).alias("x")
    suffixes = counts.select(spread, "size").where(f"size >= 2 and x.size <= least(size, {ORDER})").select("x.size", "x.key").distinct()
    low = materialize(suffixes.groupBy(F.expr(f"key & (shiftleft(1L, {BITS} * (size - 1)) - 1)").alias("key"), F.expr("size - 1").alias("size")).agg(F.count(F.lit(1)).alias("n")), "shared")
    short = low.where(f"size <= {SHORT}").select("key", F.col("size").cast("long"), "n").toArrow()  # bounded by the alphabet
    short = spark.sparkContext.broadcast([np.asarray(c) for c in short.columns])

    def run(table: pa.Table) -> pa.Table:
        top, key, size, a, b = (np.asarray(table.column(c)) for c in ("top", "key", "size", "a", "b"))
        size = size.astype(np.int64)
        own = [np.concatenate(x) for x in zip(short.value, (key[~top], size[~top], a[~top]), strict=True)]
        found, others = string_evidence((key[top], size[top], a[top], b[top]), own)
        ctx, at = np.unique(whole(key[top] >> BITS, size[top] - 1) | OTHER, return_index=True)
        out = pa.table({"string": np.concatenate([whole(key[top], size[top]), ctx]), "evidence": np.concatenate([found, others[at]])})
        release()
        return out

    rows = counts.select(F.lit(True).alias("top"), "key", "size", F.col("toxic").alias("a"), F.col("plain").alias("b")).unionAll(
        low.where(f"size > {SHORT}").select(F.lit(False).alias("top"), "key", "size", F.col("n").alias("a"), F.lit(0).cast("long").alias("b"))
    )
    groups = max(parts(spark), -(-(counts.count() + low.count()) // GROUP))
    before = F.expr(f"shiftright(key, {BITS}) & {(1 << (BITS * SHORT)) - 1}L")
    return rows.groupBy(F.pmod(F.xxhash64(before), F.lit(groups))).applyInArrow(run, "string long, evidence double")


def tables(found: DataFrame) -> list:
    """Broadcasts of the strings, sorted, and their evidence, in slices of bounded size that reach the driver one after another."""
    n = max(1, -(-found.count() // SLICE))
    made = []
    for k in range(n):
        t = found.where(F.pmod(F.xxhash64("string"), F.lit(n)) == k).toArrow()
        key, value = (np.asarray(c) for c in t.columns)
        order = np.argsort(key)
        made.append(found.sparkSession.sparkContext.broadcast((key[order], value[order].astype(np.float32))))
    return made


class Model:
    """Evidence of words, summed over their strings."""

    def __init__(self, tables: list):
        self.tables = tables

    def score(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray, dict[int, dict[tuple[int, int], float]]]:
        """Of each chunk: evidence of its strongest word, of all its words, and of each word beyond ENOUGH (named by a digest)."""
        key, size, word, chunk = strings_of(chunks)
        asked, back = np.unique(whole(key, size), return_inverse=True)
        found, known = np.zeros(len(asked)), np.zeros(len(asked), dtype=bool)
        ctx, of = np.unique(whole((asked & ((1 << 56) - 1)) >> BITS, (asked >> 56) - 1) | OTHER, return_inverse=True)
        others = np.zeros(len(ctx))
        for k, table in enumerate(self.tables):
            keys, values = table.value
            for names, out in ((asked, found), (ctx, others)):
                if len(keys):
                    at = np.minimum(np.searchsorted(keys, names), len(keys) - 1)
                    hit = keys[at] == names
                    out[hit] = values[at[hit]]
                    if out is found:
                        known |= hit
            if k >= HELD:
                del keys, values
                table.__dict__.pop("_value", None)  # read again when needed, so that memory stays bounded
        found = np.where(known, found, others[of])
        each = np.bincount(word, weights=found[back], minlength=len(chunk))
        best, sums = np.zeros(len(chunks)), np.bincount(chunk, weights=each, minlength=len(chunks))
        if len(chunk):
            first = np.flatnonzero(np.concatenate(([True], chunk[1:] != chunk[:-1])))
            best[chunk[first]] = np.maximum.reduceat(each, first)
        # A word's name: two sums over its strings, which together hold all its symbols.
        strong: dict[int, dict[tuple[int, int], float]] = {}
        if (each > ENOUGH).any():
            begin = np.searchsorted(word, np.arange(len(chunk)))
            with np.errstate(over="ignore"):
                mixed = whole(key, size).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
                names = [np.add.reduceat((mixed ^ (mixed >> np.uint64(s))) * np.uint64(0xBF58476D1CE4E5B9), begin) for s in (29, 32)]
            for w in np.flatnonzero(each > ENOUGH).tolist():
                strong.setdefault(int(chunk[w]), {})[int(names[0][w]), int(names[1][w])] = float(each[w])
        return best, sums, strong


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    labels = labels.where("toxic is not null").groupBy("doc_id").agg(F.max(F.expr("cast(toxic > 0 as int)")).alias("toxic"))
    few = labels.limit(FEW + 1).count() <= FEW
    return docs.join(F.broadcast(labels) if few else labels, "doc_id")


def fit(docs: DataFrame, labels: DataFrame) -> tuple[list, list[float] | None]:
    """Broadcasts of the evidence of strings, and the curve's weights (None: not both classes are labelled)."""
    spark = docs.sparkSession
    ship(spark)
    docs = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    part = held_out(F.col("doc_id"))
    rows = labelled(docs.where(part < 2), labels).select("text", "toxic")
    # Strings are counted where the rows lie and merged by a combinable aggregate.
    mark = written()
    counts = rows.mapInArrow(_count, "key long, size int, toxic long, plain long").groupBy("key", "size").agg(F.sum("toxic").alias("toxic"), F.sum("plain").alias("plain"))
    found = materialize(strings(materialize(counts, "strings")), "evidence")
    known = tables(found)
    drop_since(mark)  # the broadcasts hold all that is asked from now on
    seen = labelled(docs.where(part == 3), labels).select("doc_id", "text", "toxic")
    bins = [F.expr(f"cast(round((least(greatest({c}, {lo}D), {hi}D) - {lo}D) * {BINS / (hi - lo)}D) as int)").alias(c) for c, (lo, hi) in FEATURES.items()]
    binned = evidence(seen, known).groupBy(*bins, "toxic").agg(F.count(F.lit(1)).alias("n"))
    return known, curve(binned.collect())  # at most 2 * (BINS + 1) ** 3 rows, whatever the corpus


def curve(rows) -> list[float] | None:
    """Weights of the features and 1: logistic regression on binned evidence with a small ridge, by Newton steps."""
    x = np.array([[*(lo + r[c] * (hi - lo) / BINS for c, (lo, hi) in FEATURES.items()), 1.0] for r in rows]).reshape(-1, len(FEATURES) + 1)
    y = np.array([r["toxic"] for r in rows], dtype=float)
    n = np.array([r["n"] for r in rows], dtype=float)
    if not 0 < (n * y).sum() < n.sum():
        return None
    ridge, w = np.full(x.shape[1], 0.01), np.zeros(x.shape[1])
    ridge[-1], w[-1] = 0, math.log((n * y).sum() / (n * (1 - y)).sum())
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        g = x.T @ (n * (y - p)) - ridge * w
        h = (x * (n * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ x + np.diag(ridge + 1e-9)
        step = np.linalg.solve(h, g)
        step *= min(1.0, 3 / max(1e-9, np.abs(step).max()))
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w.tolist()


class Judged:
    """What is known of chunks between spaces: the strongest word's evidence, the evidence of all words, and the words beyond ENOUGH.

    Two generations of bounded size: when one is full it becomes the older one, and chunks met again move up.
    """

    def __init__(self, model: Model):
        self.model, self.best, self.sums, self.old, self.old_sums = model, {}, {}, {}, {}
        self.strong: dict[str, dict] = {}

    def learn(self, chunks: set[str]) -> None:
        new = [c for c in chunks if c not in self.best]
        if len(self.best) + len(new) > REMEMBERED:
            self.old, self.old_sums, self.best, self.sums = self.best, self.sums, {}, {}
            new = list(chunks)
        fresh = []
        for c in new:
            v = self.old.get(c)
            if v is None:
                fresh.append(c)
            else:
                self.best[c], self.sums[c] = v, self.old_sums[c]
        for k in range(0, len(fresh), 10_000):
            part = fresh[k : k + 10_000]
            best, sums, strong = self.model.score(part)
            self.best.update(zip(part, best.tolist(), strict=True))
            self.sums.update(zip(part, sums.tolist(), strict=True))
            self.strong.update((part[x], words) for x, words in strong.items())
        if len(self.strong) > 2 * REMEMBERED:
            self.strong = {c: v for c, v in self.strong.items() if c in self.best or c in self.old}

    def judge(self, text: str) -> tuple[float, float, float]:
        every = text.split(" ")
        whole = sum(map(self.sums.__getitem__, every)) / (len(text) + 20)
        own = set(every)
        best = list(map(self.best.__getitem__, own))
        words: dict[tuple[int, int], float] = {}
        for c, v in zip(own, best, strict=True):
            if v > ENOUGH:
                words |= self.strong[c]
        return math.log1p(max(0.0, max(best))), math.log1p(sum(v - ENOUGH for v in words.values()) / math.sqrt(len(own) + 10)), whole


def evidence(docs: DataFrame, known) -> DataFrame:
    """docs' columns but text, the logarithms of the strongest word's evidence and of the normalised evidence beyond ENOUGH, and the whole text's evidence for each letter."""
    keep = [c for c in docs.columns if c != "text"]

    @lean
    def run(batches):
        judged = Judged(Model(known))
        for b in slices(batches, "text", 1 << 20):
            cols = {n: b.column(k) for k, n in enumerate(b.schema.names)}
            texts = cols["text"].to_numpy(zero_copy_only=False)
            judged.learn({c for t in texts for c in t.split(" ")})  # together, so that the arrays are long
            found = np.array([judged.judge(t) for t in texts], dtype=float).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([*(cols[n] for n in keep), *map(pa.array, found.T)], names=[*keep, *FEATURES])

    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.mapInArrow(run, f"{schema}, {', '.join(f'{c} double' for c in FEATURES)}")


def scored(rows: DataFrame, known, weights: list[float] | None) -> DataFrame:
    """rows' columns but text, and the score."""
    rows = evidence(rows, known)
    if weights is None:
        value = F.lit(0.0)
    else:
        x = sum((F.least(F.greatest(F.col(c), F.lit(lo)), F.lit(hi)) * w for (c, (lo, hi)), w in zip(FEATURES.items(), weights, strict=False)), F.lit(weights[-1]))
        value = 1 / (1 + F.exp(-F.greatest(F.lit(-40.0), F.least(F.lit(40.0), x))))
    return rows.withColumn("score", value).drop(*FEATURES)


def keep_clean(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that score below the threshold."""
    kept = {c: f"kept_{k}" for k, c in enumerate(docs.columns)}  # names of docs may clash with those used here
    rows = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *(F.col(f"`{c}`").alias(n) for c, n in kept.items()))
    rows = scored(rows, *fit(docs, labels)).where(F.col("score") < threshold)
    return rows.select(*(F.col(n).alias(c) for c, n in kept.items()))


def score(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Per row: doc_id, held_out, score, predicted."""
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = scored(rows, *fit(docs, labels))
    rows = rows.select("doc_id", (held_out(F.col("doc_id")) == 2).alias("held_out"), "score")
    return rows.withColumn("predicted", F.expr(f"cast(score >= {threshold}D as int)"))
