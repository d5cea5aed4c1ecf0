"""Operator 9: token ids as ORC files.

Texts are dealt by ranges of doc_id and text hash (so that no doc_id is one task), sorted, encoded inside the tasks and written as ORC: one row a document with its ids
as an integer list (run-length encoded; no further compression, which gains little on packed ids), its place (chunk = range number, first = ids before it in the chunk) and count; row index
entries every INDEX_STRIDE rows, a Bloom filter on doc_id, and stripes of STRIPE_BYTES, so that readers split files by stripes and skip
by metadata. Reading needs no global sort: a document's start is its chunk's base, from one small row a chunk, plus `first`.

Byte-level BPE never merges across the borders of words, so a word goes through the tokenizer library once and its ids are kept for a
while, in Arrow and numpy arrays of bounded size. Within a batch Arrow's dictionary encoding finds the distinct words; those that are not kept go
through the library many at once, with spaces (or the newlines at which their lines start) between them, and the ids that show these part them again. A text with adjoining white space
characters is encoded whole. Special tokens' strings in a text are ordinary text.

Results: a null text is empty and has only the end id. doc_ids are cast to long. Null doc_ids come first; repeated doc_ids follow each other in the order of
their texts' hashes. Other columns are ignored.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Callable, Iterator
from itertools import product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_limits, saved, shared_dir, tidy

STRIPE_BYTES = 16 << 20
INDEX_STRIDE = 2000
CACHE_BYTES = 16 << 20
"""Words and their ids kept by a worker; looking words up takes a few times as much for a moment."""
END_ID = 0
SLICE_BYTES = 4 << 20
"""Text encoded at once; one longer text makes a slice by itself. Smaller slices and caches take less memory and more time, with the same ids."""
BROADCAST_CHUNKS = 1_000_000
"""Bases (12 bytes a chunk) go to all tasks up to so many chunks; beyond, rows and bases meet in a shuffle join."""

NEW_WORDS = 1 << 14
"""Words that go through the tokenizers library in one call."""

_WHITE = r"\t\x0b\f\r\x1c-\x1f\x85\p{Z}"
_TWO_SPACES, _AT_BORDER = rf"[\n{_WHITE}]{{2}}", rf"^$|^\n?[{_WHITE}]|[\n{_WHITE}]$"
_LETTERS = r"^\n?[A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{24F}]+[.,]?$"
"""Words that need no pattern to be parted: letters, and a dot or comma that is a piece of its own."""

_printed = [*range(33, 127), *range(161, 173), *range(174, 256)]
_SHOWN = {b: chr(b if b in _printed else 256 + sum(x not in _printed for x in range(b))) for b in range(256)}
"""Byte-level BPE shows a byte as its own character if that is printed, the others as characters from 256 on."""
_PARTED = _SHOWN | {ord(" "): " " + _SHOWN[ord(" ")], ord("\n"): f" {_SHOWN[ord('\n')]} ", ord("."): " .", ord(","): " ,"}
"""The same, with spaces between the pieces of words of letters."""


class Encoder:
    """Texts to ids, through a byte-level BPE file of the tokenizers library, with the ids of words kept: cache_bytes of them at most."""

    def __init__(self, path: str, cache_bytes: int = CACHE_BYTES):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import WhitespaceSplit

        self.tokenizer, self.cache_bytes = Tokenizer.from_file(path), cache_bytes
        self.tokenizer.encode_special_tokens = True
        self.parted = Tokenizer(self.tokenizer.model)
        self.parted.pre_tokenizer = WhitespaceSplit()
        vocab = self.tokenizer.get_vocab()
        self.after_space = np.zeros(max(vocab.values()) + 1, dtype=bool)
        self.after_space[[i for t, i in vocab.items() if t.startswith(_SHOWN[ord(" ")])]] = True
        self.newline = self._ids("\n")
        self.known, self.sizes, self.kept = pa.array([], pa.string()), np.zeros(0, dtype=np.int64), self.newline[:0]

    def _ids(self, text: str, parted: bool = False) -> np.ndarray:
        tokenizer = self.parted if parted else self.tokenizer
        return np.array(tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype=np.int32)

    def _apart(self, word: str) -> np.ndarray:
        """Ids of a word that is not to adjoin others: empty, or with white space at its border."""
        return np.concatenate([self.newline, self._ids(word[1:])]) if word[:1] == "\n" else self._ids(" " + word)

    def _together(self, words: pa.Array, line: bool, letters: bool) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids of each word, all ids) for words that all begin with a newline, or get a space in front. A word's first id shows this."""
        before = "" if line else " "
        text = before + pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words), before)[0].as_py()
        ids = self._ids(text.encode().decode("latin-1").translate(_PARTED), True) if letters else self._ids(text)
        first = np.flatnonzero(ids == self.newline[0] if line else self.after_space[ids])
        if len(first) != len(words):
            raise ValueError("the tokenizer's file is no byte-level BPE that parts words at spaces and newlines")
        return np.diff(first, append=len(ids)), ids

    def _learn(self, words: pa.Array) -> np.ndarray:
        """Keeps the ids of new words; the places of these words in the order in which they are kept."""
        border, letters, line = (x.to_numpy(zero_copy_only=False) for x in (pc.match_substring_regex(words, _AT_BORDER), pc.match_substring_regex(words, _LETTERS), pc.starts_with(words, "\n")))
        order = [np.flatnonzero(border)]
        alone = [self._apart(w) for w in words.take(pa.array(order[0])).to_pylist()]
        sizes, kept = [self.sizes, np.array([len(x) for x in alone], dtype=np.int64)], [self.kept, *alone]
        for at_line, of_letters in product((True, False), repeat=2):
            some = np.flatnonzero((line == at_line) & (letters == of_letters) & ~border)
            for a in range(0, len(some), NEW_WORDS):
                order.append(some[a : a + NEW_WORDS])
                n, ids = self._together(words.take(pa.array(order[-1])), at_line, of_letters)
                sizes.append(n)
                kept.append(ids)
        at = np.concatenate(order)
        self.known, self.sizes, self.kept = pa.concat_arrays([self.known, words.take(pa.array(at))]), np.concatenate(sizes), np.concatenate(kept)
        return at

    def _keep(self, at: np.ndarray) -> None:
        """Only the known words at these places stay, the text's own ones, or none if they are too many as well."""
        begin = np.cumsum(self.sizes) - self.sizes
        self.kept = _runs(self.kept, begin[at], self.sizes[at])
        self.known, self.sizes = self.known.take(pa.array(at)), self.sizes[at]
        if self._bytes() > self.cache_bytes:
            self.known, self.sizes, self.kept = self.known[:0], self.sizes[:0], self.kept[:0]

    def _bytes(self) -> int:
        return self.known.nbytes + self.sizes.nbytes + self.kept.nbytes

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, END_ID after each; number of ids of each). Words are told apart by Arrow's dictionary encoding.

        Each text gets a newline in front, so that its first word is one at the start of a line; END_ID of the text before takes that newline's place.
        """
        texts = pc.fill_null(texts, "")
        odd = np.flatnonzero(pc.match_substring_regex(texts, _TWO_SPACES).to_numpy(zero_copy_only=False))
        plain = texts
        if len(odd):
            mask = np.zeros(len(texts), dtype=bool)
            mask[odd] = True
            plain = pc.if_else(pa.array(mask), pa.scalar(""), texts)
        lists = pc.split_pattern(pc.binary_join_element_wise("\n", pc.replace_substring(plain, "\n", " \n"), ""), " ")
        first = lists.offsets.to_numpy()[:-1] - lists.offsets[0].as_py()
        words = lists.flatten().dictionary_encode()
        found = pc.fill_null(pc.index_in(words.dictionary, value_set=self.known), -1).to_numpy(zero_copy_only=False).copy()
        new = np.flatnonzero(found < 0)
        if len(new):
            n = len(self.sizes)
            found[new[self._learn(words.dictionary.take(pa.array(new)))]] = n + np.arange(len(new))
        at = found[words.indices.to_numpy(zero_copy_only=False)]
        whole = [np.concatenate([self.newline, self._ids(texts[i].as_py())]) for i in odd.tolist()]
        at[first[odd]] = len(self.sizes) + np.arange(len(odd))
        size = np.concatenate([self.sizes, np.array([len(x) for x in whole], dtype=np.int64)])
        n = size[at]
        ids = np.roll(_runs(np.concatenate([self.kept, *whole]), (np.cumsum(size) - size)[at], n), -1)
        n = np.add.reduceat(n, first) if len(first) else n
        ids[np.cumsum(n) - 1] = END_ID
        if self._bytes() > self.cache_bytes:
            self._keep(found)
        return ids, n


def _runs(values: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The runs of `size` values from `begin` on, one after another."""
    ends = np.cumsum(size)
    place = np.repeat((begin - (ends - size)).astype(np.int32), size)
    place += np.arange(len(place), dtype=np.int32)
    return values[place]


_encoders: dict[tuple[str, int], Encoder] = {}


def encoder(path: str, cache_bytes: int) -> Encoder:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if (path, cache_bytes) not in _encoders:
        _encoders.clear()
        _encoders[path, cache_bytes] = Encoder(path, cache_bytes)
    return _encoders[path, cache_bytes]


def _slices(ends: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs of rows of about `most` bytes, from the running sum of their sizes."""
    a, done = 0, 0
    while a < len(ends):
        b = max(a + 1, int(np.searchsorted(ends, done + most, side="right")))
        yield a, b
        a, done = b, int(ends[b - 1])


_FILE = "doc_id long, chunk int, first long, n_tokens long, ids array<int>"


def _writer(path: str, cache_bytes: int, slice_bytes: int) -> Callable:
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, first, encode = TaskContext.get().partitionId(), 0, encoder(path, cache_bytes).encode
        for batch in batches:
            size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            for a, b in _slices(size, slice_bytes):
                ids, n = encode(batch.column(1).slice(a, b - a))
                ends = np.cumsum(n)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(np.full(len(n), chunk, dtype=np.int32)), pa.array(first + ends - n), pa.array(n), lists], ["doc_id", "chunk", "first", "n_tokens", "ids"])
                first += int(ends[-1])

    return write


def write_tokens(docs: DataFrame, path: str, tokenizer: str, cache_bytes: int = CACHE_BYTES, slice_bytes: int = SLICE_BYTES) -> None:
    """Writes the token ids of docs to ORC files in folder `path`, in ascending doc_id order."""
    arrow_limits(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))
    options = {"orc.stripe.size": STRIPE_BYTES, "orc.row.index.stride": INDEX_STRIDE, "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01", "compression": "none"}
    rows.mapInArrow(tidy(_writer(tokenizer, cache_bytes, slice_bytes)), _FILE).write.options(**options).orc(path)


def _checksums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column(4)
        off, flat = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)
        crc = [zlib.crc32(flat[off[i] : off[i + 1]].tobytes()) for i in range(len(lists))]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(np.diff(off).astype(np.int64)), pa.array(crc, pa.int64())], ["doc_id", "chunk", "first", "n_tokens", "ids_crc32"])


def chunk_bases(spark, path: str) -> DataFrame:
    """chunk and base, the number of ids in all chunks before it: one row for each task that wrote."""
    sizes = spark.read.schema(_FILE).orc(path).groupBy("chunk").agg(F.max(F.col("first") + F.col("n_tokens")).alias("size"))
    return saved(sizes.select("chunk", (F.sum("size").over(Window.orderBy("chunk")) - F.col("size")).alias("base")))


def with_start(rows: DataFrame, bases: DataFrame) -> DataFrame:
    if bases.count() <= BROADCAST_CHUNKS:
        bases = F.broadcast(bases)
    return rows.join(bases, "chunk").withColumn("start", F.col("base") + F.col("first"))


def read_tokens(spark, path: str) -> DataFrame:
    """The files' rows, with `start`: the number of ids of all documents before each one."""
    return with_start(spark.read.schema(_FILE).orc(path), chunk_bases(spark, path))


def token_digest(docs: DataFrame, tokenizer: str, cache_bytes: int = CACHE_BYTES, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each row of docs, from files written and read back."""
    spark = docs.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{spark.sparkContext.applicationId}/tokens-{uuid.uuid4().hex}"
    write_tokens(docs, path, tokenizer, cache_bytes, slice_bytes)
    sums = spark.read.schema(_FILE).orc(path).mapInArrow(tidy(_checksums), "doc_id long, chunk int, first long, n_tokens long, ids_crc32 long")
    return with_start(sums, chunk_bases(spark, path)).select("doc_id", "start", "n_tokens", "ids_crc32")
