"""Substring deduplication by super-k-mer partitioning.

Every window of ``WINDOW`` words has a minimiser, the least hash of its runs of ``GRAM`` words, and
consecutive windows with the same one form a super-k-mer. Equal windows share their minimiser, so a
minimiser that only one document has needs no further work. For the others the super-k-mer travels as
one packed string to its minimiser's bucket; equal strings meet on the way and leave their smallest
document. A bucket sorts the windows of its strings exactly, by ranks of word pairs, of pairs of
pairs and so on, and gives each window its smallest document. The super-k-mers of a minimiser with
many places are cut further, at changes of a second minimiser over longer runs of words, which spreads
them over buckets of their own; with very many places their windows travel one by one and are only
aggregated. So no bucket is large, however common a passage is.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import Words, arrow_map, checkpointed, gram_hashes, mix, only_likely, slices

WINDOW, GRAM = 50, 12
#: Words of the second minimiser's runs.
GRAM2 = 36
#: A minimiser with more places than the first has its super-k-mers cut by the second one; with more than the other,
#: into single windows.
HOT = (200, 50_000)
#: A null doc_id counts as the largest, so it removes nothing from others.
LAST = (1 << 63) - 1
#: Bytes of packed strings that a bucket task sorts at once (whole minimisers).
CHUNK = 4_000_000


def least_of(x: np.ndarray, n: int) -> np.ndarray:
    """Minimum of each n consecutive values."""
    if len(x) < n:
        return x[:0]
    width = 1
    while width * 2 <= n:
        x = np.minimum(x[:-width], x[width:])
        width *= 2
    return np.minimum(x[: len(x) - (n - width)], x[n - width :]) if n > width else x


def super_kmers(words: Words, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, first window, windows, minimiser) of every super-k-mer, in order."""
    least = least_of(gram_hashes(words.hashes(), gram), window - gram + 1)
    if not len(least):
        return (np.empty(0, np.int64),) * 3 + (np.empty(0, np.uint64),)
    doc = words.doc_of()
    place = np.flatnonzero(doc[: len(least)] == doc[window - 1 :])
    if not len(place):
        return (np.empty(0, np.int64),) * 3 + (np.empty(0, np.uint64),)
    doc, key = doc[place], least[place]
    fresh = np.concatenate([[True], (doc[1:] != doc[:-1]) | (key[1:] != key[:-1])])
    first = np.flatnonzero(fresh)
    return doc[first], place[first] - words.offsets[doc[first]], np.diff(np.append(first, len(place))), key[first]


def summaries(rows: DataFrame, window: int, gram: int) -> DataFrame:
    """(doc_id, row, tkey, n_words, whole, minis, starts, sizes): each row's words' digest and its super-k-mers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                texts = pc.fill_null(part.column("text"), "")
                whole = [hashlib.sha256(b" ".join(t.split())).digest() for t in texts.cast(pa.binary()).to_pylist()]
                words = Words(texts, lower=False)
                doc, start, n, key = super_kmers(words, window, gram)
                offsets = pa.array(np.searchsorted(doc, np.arange(part.num_rows + 1)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (key.view(np.int64), start.astype(np.int32), n.astype(np.int32))]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("doc_id", "row", "tkey")), pa.array(words.counts), pa.array(whole, pa.binary()), *lists], names=["doc_id", "row", "tkey", "n_words", "whole", "minis", "starts", "sizes"])

    return arrow_map(rows, run, "doc_id long, row long, tkey long, n_words long, whole binary, minis array<long>, starts array<int>, sizes array<int>")


def cut_runs(words: list[bytes], runs: list[dict], window: int, gram: int) -> list[tuple[int, int, int, int]]:
    """(bucket, level, start, windows) of a text's super-k-mers, those of level 1 and 2 cut further."""
    out = [(r["mini"], 0, r["start"], r["n"]) for r in runs if r["level"] == 0]
    if len(out) == len(runs):
        return out
    hashes = Words(pa.array([b" ".join(words)], pa.binary()).cast(pa.string()), lower=False).hashes()
    least = least_of(gram_hashes(hashes, gram, seed=2), window - gram + 1)
    for r in runs:
        if r["level"] == 2:
            out += [(r["mini"], 2, r["start"] + k, 1) for k in range(r["n"])]
        elif r["level"] == 1:
            own = least[r["start"] : r["start"] + r["n"]]
            first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            key = mix(own[first] ^ np.uint64(r["mini"] & 0xFFFFFFFFFFFFFFFF)).view(np.int64)
            out += zip(key.tolist(), [1] * len(first), (r["start"] + first).tolist(), np.diff(np.append(first, r["n"])).tolist(), strict=True)
    return out


def packed_strings(rows: DataFrame, window: int, gram: int) -> DataFrame:
    """A row for each packed string of (row, tkey, runs, text): its bucket, place, digest and words (deflated)."""
    schema = "row long, tkey long, bucket long, alone boolean, start int, n int, da long, db long, packed binary"
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
    names = [f.split(" ")[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        size = 0
        for batch in batches:
            for part in slices(batch):
                for row, tkey, runs, text in zip(*(part.column(c).to_pylist() for c in ("row", "tkey", "runs", "text")), strict=True):
                    words = text.encode().split()
                    for bucket, level, start, n in cut_runs(words, runs, window, gram):
                        packed = b" ".join(words[start : start + n + window - 1])
                        digest = xxhash.xxh3_128_digest(packed)
                        out.append((row, tkey, bucket, level == 2, start, n, int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True), zlib.compress(packed, 6)))
                        size += len(packed)
                    if size > CHUNK:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds, strict=True)], names=names)
                        out, size = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds, strict=True)], names=names)

    return arrow_map(rows, run, schema)


def window_ranks(codes: np.ndarray, window: int) -> np.ndarray:
    """An integer for each window of word codes, equal for equal windows, by sorting pairs of ranks."""

    def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.unique(a.astype(np.int64) * (int(b.max(initial=0)) + 1) + b, return_inverse=True)[1]

    count = len(codes) - window + 1
    level, width, out, done = codes, 1, None, 0
    while True:
        if window & width:
            part = level[done : done + count]
            out = part if out is None else pair(out, part)
            done += width
        if width * 2 > window:
            return out
        level = pair(level[: len(level) - width], level[width:])
        width *= 2


def least_documents(strings: list[str], rows: np.ndarray, sizes: np.ndarray, window: int) -> list[np.ndarray]:
    """For each packed string, the smallest row at each of its windows, among all these strings."""
    words = Words(pa.array(strings, pa.string()), lower=False)
    ranks = window_ranks(words.codes, window)
    place = np.repeat(words.offsets[:-1] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
    rank = ranks[place]
    least = np.full(int(rank.max(initial=0)) + 1, LAST, np.int64)
    np.minimum.at(least, rank, np.repeat(rows, sizes))
    return np.split(least[rank], np.cumsum(sizes)[:-1])


def bucket_windows(strings: DataFrame, window: int) -> DataFrame:
    """(da, db, least): strings (bucket, n, da, db, packed, first) come sorted by bucket within each partition."""

    def done(held: list[tuple]) -> pa.RecordBatch:
        least = least_documents([h[4] for h in held], np.array([h[5] for h in held], np.int64), np.array([h[1] for h in held], np.int64), window)
        return pa.RecordBatch.from_arrays([pa.array([h[2] for h in held], pa.int64()), pa.array([h[3] for h in held], pa.int64()), pa.array([x.tolist() for x in least], pa.list_(pa.int64()))], names=["da", "db", "least"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size, last = 0, None
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("bucket", "n", "da", "db", "packed", "first")), strict=True):
                if size > CHUNK and row[0] != last:
                    yield done(held)
                    held, size = [], 0
                held.append((*row[:4], zlib.decompress(row[4]).decode(), row[5]))
                size, last = size + len(held[-1][4]), row[0]
        if held:
            yield done(held)

    return arrow_map(strings, run, "da long, db long, least array<long>")


def _shortened(rows: DataFrame, window: int) -> DataFrame:
    """(row, tkey, n_removed, kept) of texts and the starts of the windows to remove from them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                removed, kept = [], []
                for starts, text in zip(part.column("starts").to_pylist(), part.column("text").to_pylist(), strict=True):
                    words = text.encode().split()
                    edge = np.zeros(len(words) + 1, np.int64)
                    at = np.unique(np.fromiter((s for some in starts for s in some), np.int64))
                    np.add.at(edge, at, 1)
                    np.add.at(edge, at + window, -1)
                    gone = np.cumsum(edge[:-1]) > 0
                    removed.append(int(gone.sum()))
                    kept.append(hashlib.sha256(b" ".join(w for w, g in zip(words, gone.tolist(), strict=True) if not g)).digest())
                yield pa.RecordBatch.from_arrays([part.column("row"), part.column("tkey"), pa.array(removed, pa.int64()), pa.array(kept, pa.binary())], names=["row", "tkey", "n_removed", "kept"])

    return arrow_map(rows, run, "row long, tkey long, n_removed long, kept binary")


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, gram2: int = GRAM2, hot: tuple[int, int] = HOT) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256.

    A word goes if a window that covers it also starts in a document with a smaller doc_id, as the
    input has it. A null text has no words. A null doc_id counts as the largest and removes nothing.
    Rows that repeat a doc_id do not remove each other's words and get a row each. Extra columns are
    ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("row"), F.coalesce("text", F.lit("")).alias("text")).withColumn("tkey", F.xxhash64("text"))
    summary = checkpointed(summaries(rows, window, gram))
    parts = F.explode(F.arrays_zip("minis", "starts", "sizes")).alias("r")
    runs = summary.select("row", "tkey", parts).select("row", "tkey", F.xxhash64("r.minis").alias("mini"), F.col("r.starts").alias("start"), F.col("r.sizes").alias("n"))
    shared = runs.groupBy("mini").agg(F.min("row").alias("low"), F.max("row").alias("high"), F.count(F.lit(1)).alias("places")).where("low <> high")
    level = F.when(F.col("places") > hot[1], 2).when(F.col("places") > hot[0], 1).otherwise(0)
    # dealt by a key that the grouping does not know, so the places of a common minimiser can be split
    shared = shared.select(F.xxhash64("mini").alias("key"), level.alias("level"))
    needed = runs.withColumn("key", F.xxhash64("mini")).join(shared, "key").withColumnRenamed("key", "bucket")
    wanted = needed.groupBy("row", "tkey").agg(F.collect_set(F.struct(F.col("bucket").alias("mini"), "start", "n", "level")).alias("runs"))
    wanted = checkpointed(wanted)
    texts = rows.select("row", "tkey", "text")
    pieces = checkpointed(packed_strings(wanted.join(only_likely(texts, wanted), ["row", "tkey"]), window, gram2))
    strings = pieces.groupBy("bucket", "alone", "n", "da", "db", "packed").agg(F.min("row").alias("first"))
    alone = strings.where("alone").select("da", "db", F.array("first").alias("least"))
    bucketed = strings.where("not alone").select("bucket", "n", "da", "db", "packed", "first").repartition("bucket").sortWithinPartitions("bucket")
    least = alone.union(bucket_windows(bucketed, window))
    least = least.select(F.xxhash64("da", "db").alias("key"), F.col("da").alias("la"), F.col("db").alias("lb"), "least")
    places = pieces.select("row", "tkey", "start", "da", "db").withColumn("key", F.xxhash64("da", "db"))
    told = places.join(least, (places["key"] == least["key"]) & (places["da"] == least["la"]) & (places["db"] == least["lb"]))
    hits = F.filter(F.transform("least", lambda x, i: F.when(x < F.col("row"), F.col("start") + i)), lambda x: x.isNotNull())
    marks = told.select("row", "tkey", hits.alias("starts")).where(F.size("starts") > 0).groupBy("row", "tkey").agg(F.collect_list("starts").alias("starts"))
    marks = checkpointed(marks)
    short = _shortened(marks.join(only_likely(texts, marks), ["row", "tkey"]), window).dropDuplicates(["row", "tkey"])
    whole = summary.select("doc_id", "row", "tkey", "n_words", "whole")
    out = whole.join(short, ["row", "tkey"], "left")
    return out.select("doc_id", "n_words", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), F.lower(F.hex(F.coalesce("kept", "whole"))).alias("kept_sha256"))


SQL = r"""
with words as (
  select doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents
), windows as (
  select doc_id, i, array_to_string(w[i:i + 49], ' ') as win from (select doc_id, w, unnest(range(1, len(w) - 48)) as i from words)
), flagged as (
  select doc_id, i, min(doc_id) over (partition by win) < doc_id as dup from windows
), gone as (
  select distinct doc_id, unnest(range(i, i + 50)) as p from flagged where dup
), gone_list as (
  select doc_id, list(p) as ps, count(*) as n from gone group by doc_id
), kept as (
  select w.doc_id, len(w.w) as n_words, coalesce(g.n, 0) as n_removed, w.w as w, g.ps as ps
  from words w left join gone_list g on w.doc_id = g.doc_id
), kept_words as (
  select doc_id, string_agg(x, ' ' order by p) as t from (
    select k.doc_id, unnest(k.w) as x, unnest(range(1, len(k.w) + 1)) as p from kept k
  ) e where not exists (select 1 from gone g where g.doc_id = e.doc_id and g.p = e.p) group by doc_id
)
select k.doc_id, cast(k.n_words as bigint) as n_words, cast(k.n_removed as bigint) as n_removed, sha256(coalesce(t.t, '')) as kept_sha256
from kept k left join kept_words t on k.doc_id = t.doc_id
"""
