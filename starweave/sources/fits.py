"""Binary tables of FITS files, plain or gzipped: read through Spark's own file access, so any store serves."""

from __future__ import annotations

import gzip
import re
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship

BLOCK = 2880
CARD = 80
#: Column formats: numpy's big-endian type, Spark's type. Fixed values.
FORMATS = {"L": ("u1", "boolean"), "B": ("u1", "smallint"), "I": (">i2", "smallint"), "J": (">i4", "int"), "K": (">i8", "bigint"), "E": (">f4", "float"), "D": (">f8", "double"), "A": ("S", "string")}
_ARROW = {"boolean": pa.bool_(), "smallint": pa.int16(), "int": pa.int32(), "bigint": pa.int64(), "float": pa.float32(), "double": pa.float64(), "string": pa.string()}


def header(raw: bytes, at: int) -> tuple[dict[str, object], int]:
    """Keywords of the header at a place, and where its data begin."""
    cards: dict[str, object] = {}
    while True:
        block, at = raw[at : at + BLOCK], at + BLOCK
        if len(block) < BLOCK:
            raise ValueError("the header ends early")
        for k in range(0, BLOCK, CARD):
            card = block[k : k + CARD].decode("ascii", "replace")
            key = card[:8].strip()
            if key == "END":
                return cards, at
            if card[8:10] == "= ":
                value = card[10:].strip()
                text = re.match(r"'((?:[^']|'')*)'", value)
                if text:
                    cards[key] = text[1].replace("''", "'").rstrip()
                else:
                    value = value.split("/")[0].strip()
                    cards[key] = value == "T" if value in ("T", "F") else int(value) if re.fullmatch(r"[+-]?\d+", value) else float(value.replace("D", "E")) if value else None


def table(raw: bytes) -> tuple[dict[str, object], np.ndarray]:
    """Keywords and rows of the first binary table."""
    if raw[:2] == b"\x1f\x8b":
        raw = gzip.decompress(raw)
    at = 0
    while at < len(raw):
        cards, data = header(raw, at)
        size = abs(int(cards.get("BITPIX", 8))) // 8 * (int(np.prod([int(cards[f"NAXIS{k + 1}"]) for k in range(int(cards.get("NAXIS", 0)))])) if cards.get("NAXIS") else 0) + int(cards.get("PCOUNT", 0) or 0)
        if cards.get("XTENSION") == "BINTABLE":
            names, kinds = [], []
            for k in range(1, int(cards["TFIELDS"]) + 1):
                n, letter = re.fullmatch(r"(\d*)([LBIJKEDA]).*", str(cards[f"TFORM{k}"])).groups()
                n = int(n or 1)
                names.append(str(cards[f"TTYPE{k}"]))
                kinds.append((f"S{n}",) if letter == "A" else (FORMATS[letter][0],) if n == 1 else (FORMATS[letter][0], (n,)))
            kind = np.dtype([(a, *b) for a, b in zip(names, kinds, strict=True)])
            return cards, np.frombuffer(raw, dtype=kind, count=int(cards["NAXIS2"]), offset=data)
        at = data + -(-size // BLOCK) * BLOCK
    raise ValueError("no binary table")


def read_fits(spark: SparkSession, paths: str | Sequence[str], columns: dict[str, str], optional: Sequence[str] = (), rename: dict[str, str] | None = None) -> DataFrame:
    """Columns (name: Spark type) of binary tables, with file (the path) beside them.

    A missing column is an error, or null if it is optional. One task reads one file at a time.
    """
    ship(spark)
    files = spark.read.format("binaryFile").load(paths if isinstance(paths, str) else list(paths)).select("path", "content")

    def run(batches):
        for b in batches:
            for path, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                cards, rows = table(raw)
                lost = [c for c in columns if c not in rows.dtype.names and c not in optional]
                if lost:
                    raise KeyError(f"{path} lacks {', '.join(lost)}")
                for k in range(0, len(rows), 100_000):
                    part, out = rows[k : k + 100_000], []
                    for c, kind in columns.items():
                        if c not in rows.dtype.names:
                            out.append(pa.nulls(len(part), _ARROW[kind]))
                            continue
                        v = part[c]
                        if v.dtype.kind == "S":
                            out.append(pa.array([x.decode("utf-8", "replace").rstrip(" \0") for x in v.tolist()]))
                        elif kind == "boolean":
                            out.append(pa.array(v == ord("T")))
                        else:
                            out.append(pa.array(v.astype(v.dtype.newbyteorder("="))).cast(_ARROW[kind]))
                    yield pa.RecordBatch.from_arrays([*out, pa.array([path] * len(part))], names=[*columns, "file"])

    df = files.mapInArrow(run, ", ".join(f"`{c}` {k}" for c, k in columns.items()) + ", file string")
    for a, b in (rename or {}).items():
        df = df.withColumnRenamed(a, b)
    return df


def _card(key: str, value: object) -> bytes:
    text = f"'{str(value).replace(chr(39), chr(39) * 2):<8}'" if isinstance(value, str) else f"{'T' if value else 'F':>20}" if isinstance(value, bool) else f"{value:>20}"
    return f"{key:<8}= {text}".ljust(CARD)[:CARD].encode("ascii", "replace")


def _padded(raw: bytes, fill: bytes) -> bytes:
    return raw + fill * (-len(raw) % BLOCK)


def fits_bytes(batch: pa.Table, meta: dict[str, object], zipped: bool = False) -> bytes:
    """A file with one binary table."""
    cols, cards = [], []
    for k, f in enumerate(batch.schema, 1):
        v = batch.column(f.name).combine_chunks()
        if pa.types.is_boolean(f.type):
            letter, a = "L", np.where(np.asarray(v.fill_null(False).cast(pa.uint8())) == 1, ord("T"), ord("F")).astype("u1")
        elif pa.types.is_string(f.type):
            raw = [x.encode() for x in v.fill_null("").to_pylist()]
            n = max(map(len, raw), default=1) or 1
            letter, a = f"{n}A", np.array(raw, dtype=f"S{n}")
        else:
            letter = {pa.int16(): "I", pa.int32(): "J", pa.int64(): "K", pa.float32(): "E", pa.float64(): "D"}[f.type]
            a = np.asarray(v.fill_null(0 if letter in "IJK" else float("nan"))).astype(FORMATS[letter][0])
        cols.append((f.name, a))
        cards += [_card(f"TTYPE{k}", f.name), _card(f"TFORM{k}", letter)]
    kind = np.dtype([(n, a.dtype) for n, a in cols])
    rows = np.zeros(batch.num_rows, dtype=kind)
    for n, a in cols:
        rows[n] = a
    first = [_card("SIMPLE", True), _card("BITPIX", 8), _card("NAXIS", 0), _card("EXTEND", True), b"END".ljust(CARD)]
    head = [_card("XTENSION", "BINTABLE"), _card("BITPIX", 8), _card("NAXIS", 2), _card("NAXIS1", kind.itemsize), _card("NAXIS2", len(rows)), _card("PCOUNT", 0), _card("GCOUNT", 1), _card("TFIELDS", len(cols)), *cards, *(_card(k[:8].upper(), v) for k, v in meta.items()), b"END".ljust(CARD)]
    raw = _padded(b"".join(first), b" ") + _padded(b"".join(head), b" ") + _padded(rows.tobytes(), b"\0")
    return gzip.compress(raw) if zipped else raw


def write_fits(df: DataFrame, folder: str, meta: dict[str, object] | None = None, zipped: bool = False) -> list[str]:
    """A file for each partition of df, made by the executors, written under another name and then renamed.

    The driver passes one partition's bytes at a time on to the store; large products belong in Parquet.
    """
    spark = df.sparkSession
    ship(spark)
    meta = meta or {}

    def run(batches):
        own = list(batches)
        if own:
            yield pa.RecordBatch.from_arrays([pa.array([fits_bytes(pa.Table.from_batches(own), meta, zipped)], type=pa.binary())], names=["content"])

    jvm = spark.sparkContext._jvm
    paths = []
    for k, row in enumerate(df.mapInArrow(run, "content binary").toLocalIterator()):
        path = jvm.org.apache.hadoop.fs.Path(f"{folder}/part-{k:05d}.fits{'.gz' if zipped else ''}")
        fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        tmp = jvm.org.apache.hadoop.fs.Path(str(path) + ".tmp")
        out = fs.create(tmp, True)
        out.write(bytes(row["content"]))
        out.close()
        fs.delete(path, False)
        fs.rename(tmp, path)
        paths.append(str(path))
    return paths


def row_counts(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """path and rows, from headers."""
    ship(spark)
    files = spark.read.format("binaryFile").load(paths if isinstance(paths, str) else list(paths)).select("path", "content")

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([int(table(x)[0]["NAXIS2"]) for x in b.column(1).to_pylist()], type=pa.int64())], names=["path", "rows"])

    return files.mapInArrow(run, "path string, rows long").select(F.col("path"), F.col("rows"))
