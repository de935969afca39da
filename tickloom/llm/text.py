"""Arrow and numpy helpers that the text operators share.

Words are maximal runs of bytes other than space and 0x09-0x0D, so UTF-8 buffers can be cut without
decoding them. Every helper works on slices of a batch, which bounds a worker's memory whatever the
batch size and however long a single text is.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.session import ensure_importable

SLICE_BYTES = 3_000_000
MIX = np.uint64(0x9E3779B97F4A7C15)


def slices(batch: pa.RecordBatch, column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Row slices of a batch whose text is about ``most`` bytes; one longer text is a slice of its own."""
    n = batch.num_rows
    if n == 0:
        return
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0)).astype(np.int64)
    first, total = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if i > first and total + size > most:
            yield batch.slice(first, i - first)
            first, total = i, 0
        total += size
    yield batch.slice(first, n - first)


class Words:
    """The words of some texts: ``codes`` into ``vocabulary``, and for each text where its words begin."""

    def __init__(self, texts: pa.Array, lower: bool) -> None:
        texts = pc.fill_null(texts, "")
        if pa.types.is_large_string(texts.type):
            texts = texts.cast(pa.string())
        if lower:
            texts = pc.ascii_lower(texts)
        parts = pc.ascii_split_whitespace(texts)
        flat, ends = parts.flatten(), np.cumsum(np.asarray(pc.list_value_length(parts)), dtype=np.int64)
        full = np.asarray(pc.greater(pc.binary_length(flat), 0))
        before = np.concatenate([[0], np.cumsum(full)])
        self.offsets = np.concatenate([[0], before[ends]]).astype(np.int64)
        coded = flat.filter(pa.array(full)).dictionary_encode()
        self.codes = np.asarray(coded.indices).astype(np.int64)
        self.vocabulary = coded.dictionary

    def __len__(self) -> int:
        return len(self.codes)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.offsets)

    def doc_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.offsets) - 1), self.counts)

    def distinct(self, counted: bool = False) -> tuple[np.ndarray, ...]:
        """(text, code) of the distinct words of each text, in order; counted: and how often each occurs."""
        n, texts = max(1, len(self.vocabulary)), len(self.offsets) - 1
        kind = np.uint32 if n * texts < 1 << 32 else np.int64  # half as wide is twice as fast to sort
        key = self.doc_of().astype(kind) * kind(n) + self.codes.astype(kind)
        key.sort()
        fresh = np.ones(len(key), bool)
        fresh[1:] = key[1:] != key[:-1]
        first = np.flatnonzero(fresh)
        doc, code = np.divmod(key[first], kind(n))
        out = doc.astype(np.int64), code.astype(np.int64)
        return (*out, np.diff(np.append(first, len(key)))) if counted else out

    def hashes(self) -> np.ndarray:
        """A 64-bit hash for each word, equal wherever the word is."""
        return hash_words(self.vocabulary)[self.codes]


def hash_words(vocabulary: pa.Array) -> np.ndarray:
    digests = b"".join(map(xxhash.xxh3_64_digest, vocabulary.cast(pa.binary()).to_pylist()))
    return np.frombuffer(digests, ">u8").astype(np.uint64)


def hash_pairs(vocabulary: pa.Array, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of each word, as signed integers: words of up to 16 bytes as two numbers, others by xxhash."""
    words = vocabulary.cast(pa.binary())
    if not len(words):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    ends = np.frombuffer(words.buffers()[1], np.int32, len(words) + 1, words.offset * 4)
    begin, size = ends[:-1], np.diff(ends)
    data = np.concatenate([np.frombuffer(words.buffers()[2], np.uint8)[: ends[-1]], np.zeros(16, np.uint8)])
    some = np.lib.stride_tricks.sliding_window_view(data, 16)[begin].view(np.uint64)  # 16 bytes from each word's first on
    one, two = some[:, 0], some[:, 1]
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    one = np.where(size < 8, one & ~(full << (np.minimum(size, 7) * 8).astype(np.uint64)), one)
    two = np.where(size < 16, two & ~(full << (np.clip(size - 8, 0, 7) * 8).astype(np.uint64)), two)
    out = []
    for salt in (1, 2):
        start = mix(np.array([seed * 2 + salt], np.uint64))
        out.append(mix(mix(mix(one ^ start) * np.uint64(0xD6E8FEB86659FD93) + two) * MIX + size.astype(np.uint64)))
    for w in np.flatnonzero(size > 16).tolist():
        digest = xxhash.xxh3_128_intdigest(words[w].as_py(), seed)
        out[0][w], out[1][w] = digest & int(full), digest >> 64
    return out[0].view(np.int64), out[1].view(np.int64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser over unsigned 64-bit integers."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def gram_hashes(words: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """Hash of each ``n`` consecutive word hashes, by doubling; position i covers words i .. i+n-1."""
    count = len(words) - n + 1
    if count <= 0:
        return np.empty(0, np.uint64)
    level, width, out, done = mix(words + np.uint64(seed * int(MIX) & 0xFFFFFFFFFFFFFFFF)), 1, None, 0
    while True:
        if n & width:
            part = level[done : done + count]
            out = part.copy() if out is None else mix(out * np.uint64(0xD6E8FEB86659FD93) + part)
            done += width
        if width * 2 > n:
            return out
        level = mix(level[:-width] * np.uint64(0xA0761D6478BD642F) + level[width:])
        width *= 2


def arrow_map(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    ensure_importable(df.sparkSession)
    return df.mapInArrow(f, schema)


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster shares; only a session that names none, as in tests, gets a local one."""
    return spark.conf.get("spark.checkpoint.dir", None) or os.path.join(tempfile.gettempdir(), "tickloom-checkpoints")


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut lineage into the shared folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


#: Bits of the filter in ``only_likely``: 16 MB, whatever the number of keys.
FILTER_BITS = 1 << 27


def only_likely(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """rows (row, tkey, text) without most of those whose (row, tkey) is not among ``keys``.

    A Bloom filter of fixed size goes ahead of a join, so that texts which cannot match do not travel.
    It never drops a match; the more keys it holds, the more others pass as well.
    """
    spark = rows.sparkSession
    hashed = F.xxhash64("row", "tkey")
    places = F.explode(F.array(*[F.pmod(F.shiftrightunsigned("h", k), F.lit(FILTER_BITS)) for k in (0, 31)]))
    words = keys.select(hashed.alias("h")).select(places.alias("p")).groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p % 64 as int))")).alias("b")).toArrow()
    bits = np.zeros(FILTER_BITS // 64, np.int64)
    bits[np.asarray(words.column("w"))] = np.asarray(words.column("b"))
    shared = spark.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value.view(np.uint64)
        for batch in batches:
            h = np.asarray(batch.column("h")).view(np.uint64)
            ok = np.ones(len(h), bool)
            for k in (0, 31):
                p = (h >> np.uint64(k)).view(np.int64) % FILTER_BITS
                ok &= (table[p >> 6] >> (p % 64).astype(np.uint64)) & np.uint64(1) == 1
            yield batch.filter(pa.array(ok)).drop_columns(["h"])

    return arrow_map(rows.select("row", "tkey", "text", hashed.alias("h")), run, "row long, tkey long, text string")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def crc_mod(column: str, n: int):
    """crc32 of an id written as decimal text, modulo n (null for a null id)."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(n))
