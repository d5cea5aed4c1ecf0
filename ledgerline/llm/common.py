"""Shared helpers of the corpus operators: tables, saved stages, and vectorised words over Arrow text."""

from __future__ import annotations

import functools
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPACE = "\x20\x09\x0a\x0b\x0c\x0d"
"""The six white-space characters that end a word in every operator here."""

CHUNK_BYTES = 1 << 20
"""Text handled at once inside a task; one longer text makes a chunk by itself."""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a temporary one where it is unset and Spark runs in one process (tests)."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not re.fullmatch(r"local(\[[^,\]]*(,[^\]]*)?\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="ledgerline-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at


def saved(df: DataFrame, **options: str) -> DataFrame:
    """`df` written as Parquet, with these options of the writer, to the shared folder and read back: lineage ends here and lost executors cost nothing.

    Files lie under <shared folder>/<application id>, which can be removed when the application has ended.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def row_key() -> Column:
    """Tells rows apart for joins inside an operator: id and text hash, nulls included. Rows equal in both give equal results."""
    return F.struct(F.col("doc_id").alias("i"), F.xxhash64("text").alias("h"))


def crc_mod(n: int) -> Column:
    return F.crc32(F.col("doc_id").cast("string")) % n


def one_partition_of(rows: int, per: int, least: int, most: int = 1 << 20) -> int:
    return max(least, min(most, -(-rows // per)))


# ---- vectorised words ---------------------------------------------------------------------------------------------

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_P = 0x9E3779B97F4A7C15
_PINV = pow(_P, -1, 2**64)
_pow: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    got = _pow.get(base)
    if got is None or len(got) < n:
        got = np.full(max(n, CHUNK_BYTES + 1), base, dtype=np.uint64)
        got[0] = 1
        np.multiply.accumulate(got, out=got)
        if len(got) <= 4 * CHUNK_BYTES:
            _pow[base] = got
    return got


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """The 64-bit finaliser of splitmix: a bijection for each seed, which spreads every input bit."""
    z = x + np.uint64((int(seed) * 0xD1342543DE82EF95 + 0x2545F4914F6CDD1D) % 2**64)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def byte_table(lower: bool = True, alnum: bool = False) -> np.ndarray:
    """For each byte its letter in a word, or 0 where words end. alnum: words are a-z, 0-9 and all above ASCII."""
    t = np.arange(256, dtype=np.uint8)
    for b in range(128):
        keep = (48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122) if alnum else b not in b" \t\n\x0b\x0c\r"
        t[b] = (b + 32 if lower and 65 <= b <= 90 else b) if keep else 0
    if not alnum:
        t[0] = 1  # a NUL character is part of a word
    return t


class Words:
    """Words of a run of texts: byte bounds in `data`, text number and 64-bit hash of each."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, letters: np.ndarray):
        self.data, self.offsets, self.n_docs = data, offsets, len(offsets) - 1
        mapped = letters[data]
        inside = np.zeros(len(data) + 2, dtype=bool)
        inside[1:-1] = mapped != 0
        first = np.zeros(len(data) + 1, dtype=bool)
        first[offsets] = True
        here, before = inside[1:], inside[:-1]
        self.start = np.flatnonzero(here & (~before | first))
        self.end = np.flatnonzero(before & (~here | first))
        self.doc = np.searchsorted(offsets, self.start, side="right") - 1
        self.n_words = np.bincount(self.doc, minlength=self.n_docs)
        self.word_at = np.concatenate([[0], np.cumsum(self.n_words)])
        total = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(_BYTE[mapped] * _powers(_P, len(data))[: len(data)], out=total[1:])
        self.hash = mix((total[self.end] - total[self.start]) * _powers(_PINV, len(data) + 1)[self.start] + (self.end - self.start).astype(np.uint64))

    def text(self, i: int) -> str:
        return self.data[self.start[i] : self.end[i]].tobytes().decode("utf-8", "replace")


def run_hash(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k words; run i starts at word i (texts are not told apart here)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    for j in range(k):
        out = out * np.uint64(0xC2B2AE3D27D4EB4F) + words[j : j + n]
    return mix(out, k)


def chunks(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row count, bytes, offsets) for runs of rows of about CHUNK_BYTES of text; a null is an empty text."""
    if pa.types.is_large_string(column.type):
        column = column.cast(pa.string())
    n = len(column)
    if not n:
        return
    off = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None and raw.size else np.zeros(0, dtype=np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, min(n, i + 4096, int(np.searchsorted(off, off[i] + CHUNK_BYTES, side="right")) - 1))
        yield i, j - i, data[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


def tidy(f: Callable) -> Callable:
    """f, a function from batches to batches for mapInArrow, which gives Arrow's unused memory back now and then and at its end.

    Python workers serve one task after another; what Arrow's allocator keeps would add up from stage to stage.
    """

    @functools.wraps(f)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pool = pa.default_memory_pool()
        for i, batch in enumerate(f(batches)):
            yield batch
            if i % 16 == 15:
                pool.release_unused()
        pool.release_unused()

    return run


def arrow_limits(spark: SparkSession) -> None:
    """Batches of at most 2,000 rows, unless the session already asks for fewer: long texts then stay within a worker."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > 2000:
        spark.conf.set(key, "2000")
