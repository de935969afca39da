"""Hierarchical multi-length packing of token sequences.

Windows have the context sizes of a few tiers, all powers of two. A document's full windows of the
largest tier stand alone; its remainder goes to the smallest tier that holds it. Tiers are packed from
the largest down: each remainder opens a window, the gap is filled with the longest shorter remainders
that fit and at last by a piece cut from one. What is left at the end of a block of documents waits
for the next block; at the end of the partition it is cut into windows of decreasing powers of two,
so no window needs padding. Windows of one size are dealt over the whole output to step groups, and a
group of any size holds the same number of tokens.
"""

from __future__ import annotations

import bisect
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bpe
from .text import arrow_map, checkpointed, slices
from .tokencount import engine

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, context long, place long"
TIERS = (4096, 2048, 1024, 512, 256)
END = 2
BLOCK_TOKENS = 2_000_000
GROUP_TOKENS = 64 * 4096


def encode_texts(texts: list[str], path: str) -> tuple[np.ndarray, np.ndarray]:
    """(bounds, ids): each text's ids as the word-level tokenizer file gives them."""
    model = engine(path)
    plain, data, rest = bpe.latin1_parts(texts, [])
    lower = [d.decode("latin-1").lower().encode("latin-1") for d in data]
    special = model.special
    odd = [k for k, d in enumerate(lower) if b"<|" in d and any(s in texts[plain[k]] for s in special)]
    for k in reversed(odd):
        rest.append(plain.pop(k))
        lower.pop(k)
    counts = np.zeros(len(texts), np.int64)
    parts: list[tuple[np.ndarray, np.ndarray]] = []
    sizes = np.array([len(d) for d in lower], np.int64)
    joined = b"".join(lower)
    if joined:
        full = np.flatnonzero(sizes > 0)
        first = (np.cumsum(sizes) - sizes)[full]
        raw = np.frombuffer(joined, np.uint8)
        starts = bpe.cut_words_style(raw, first)
        codes, words = bpe.dictionary(joined, starts)
        begin = np.frombuffer(words.buffers()[1], np.int32, len(words) + 1)[:-1]
        blank = bpe.CLASSES[np.frombuffer(words.buffers()[2], np.uint8)[begin]] == bpe.SPACE
        words = pc.if_else(pa.array(blank), pa.scalar(b"", pa.binary()), words)
        bound, ids = model.encode(words, latin1=True, want_ids=True)
        size = np.diff(bound)[codes]
        each = np.add.reduceat(size, np.searchsorted(starts, first))
        owner = np.array(plain)[full]
        counts[owner] = each
        place = np.repeat(bound[:-1][codes] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        parts.append((np.repeat(owner, each), ids[place]))
    for i in rest:
        own = np.array(model.library.encode(texts[i], add_special_tokens=False).ids, np.int32)
        counts[i] = len(own)
        parts.append((np.full(len(own), i), own))
    bounds = np.concatenate([[0], np.cumsum(counts)])
    if len(parts) == 1 and not rest:
        return bounds, parts[0][1]
    if not parts:
        return bounds, np.empty(0, np.int32)
    owner = np.concatenate([p[0] for p in parts])
    return bounds, np.concatenate([p[1] for p in parts])[np.argsort(owner, kind="stable")]


class Packer:
    """Packs (document, start, length) remainders into windows; a window is a list of pieces."""

    def __init__(self, tiers: tuple[int, ...] = TIERS) -> None:
        if any(t & (t - 1) for t in tiers) or list(tiers) != sorted(tiers, reverse=True):
            raise ValueError("tiers are decreasing powers of two")
        self.tiers, self.top = tiers, tiers[0]
        self.waiting: list[tuple[int, int, int]] = []  # (length, document, start), ascending

    def add(self, document: int, n: int, out: list) -> None:
        """Full windows leave at once; the remainder waits."""
        full = n // self.top
        out.extend((self.top, [(document, k * self.top, self.top)]) for k in range(full))
        if n % self.top:
            self.waiting.append((n % self.top, document, full * self.top))

    def flush(self, out: list, last: bool) -> None:
        """Pack what waits; unless it is the last block, a rest below one top window stays."""
        self.waiting.sort()
        left = sum(w[0] for w in self.waiting)
        while self.waiting and (last or left >= self.top):
            longest = self.waiting[-1][0]
            size = next(t for t in reversed(self.tiers) if t >= longest)
            if left < size:  # only at the end: the largest power of two that can be filled
                size = 1 << (left.bit_length() - 1)
            window, room = [], size
            while room:
                k = bisect.bisect_right(self.waiting, (room, 1 << 62, 0)) - 1
                if k >= 0:
                    length, document, start = self.waiting.pop(k)
                else:  # nothing fits whole: cut the shortest
                    length, document, start = self.waiting.pop(0)
                    bisect.insort(self.waiting, (length - room, document, start + room))
                    length = room
                window.append((document, start, length))
                room -= length
            left -= size
            out.append((size, window))


def pack(docs: DataFrame, path: str, tiers: tuple[int, ...] = TIERS, end: int = END, group_tokens: int = GROUP_TOKENS) -> DataFrame:
    """Packed pieces (see pieces) with their step groups (see step_groups).

    The pieces are written to the shared folder first: groups need counts of all of them, and texts are
    then encoded once. An empty table gives no rows.
    """
    return step_groups(checkpointed(pieces(docs, path, tiers, end)), group_tokens)


def step_groups(packed: DataFrame, group_tokens: int = GROUP_TOKENS) -> DataFrame:
    """Adds step_group: windows of one size, numbered over all partitions, are dealt in runs of group_tokens / size.

    So every group but the last of each size holds group_tokens tokens. What is joined back is one row
    for each partition and size, so it grows with the tasks only. The last six bits of a group's number
    are its size's logarithm, so sizes never share a group.
    """
    task = F.shiftright("sequence_id", 32).alias("task")
    counts = packed.groupBy(task, "context").agg((F.max("place") + 1).alias("n"))
    running = Window.partitionBy("context").orderBy("task")
    before = counts.select("task", "context", (F.sum("n").over(running) - F.col("n")).alias("before"))
    number = F.floor((F.col("before") + F.col("place")) / F.greatest(F.lit(group_tokens) / F.col("context"), F.lit(1))).cast("long")
    size = F.log2("context").cast("long")
    rows = packed.withColumn("task", task).join(before, ["task", "context"])
    return rows.select(*[c for c in packed.columns if c != "place"], (F.shiftleft(number, 6) + size).alias("step_group"))


def pieces(docs: DataFrame, path: str, tiers: tuple[int, ...] = TIERS, end: int = END) -> DataFrame:
    """One row per piece of a document in a window ("sequence") of at most ``tiers[0]`` tokens.

    Each partition packs its own rows, block by block, so nothing is shuffled and memory holds one
    block's ids. A null text is empty and packs only its end token. Rows that repeat, and null ids,
    are packed row by row. Extra columns are ignored. sequence_id is the partition's number times
    2^32 plus the window's; place counts the windows of its size in the partition. A text of any length
    is encoded whole; its full windows leave at once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        base = (task.partitionId() if task else 0) << 32
        packer, held, ready, windows, per_size = Packer(tiers), {}, 0, 0, Counter()
        serial = 0

        def emit(last: bool) -> pa.RecordBatch:
            nonlocal windows
            out: list = []
            for document in fresh:
                packer.add(document, len(held[document][1]), out)
            fresh.clear()
            packer.flush(out, last)
            rows = []
            for size, window in out:
                place = per_size[size]
                per_size[size] += 1
                at = 0
                for document, start, length in window:
                    doc_id, ids, total = held[document]
                    rows.append((doc_id, start, length, zlib.crc32(ids[start : start + length]), total, base + windows, at, size, place))
                    at += length
                windows += 1
            kept = {w[1] for w in packer.waiting}
            for document in [d for d in held if d not in kept]:
                del held[document]
            columns = list(zip(*rows)) if rows else [[]] * 9
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "context", "place"])

        fresh: list[int] = []
        for batch in batches:
            for part in slices(batch):
                ids_of = part.column("doc_id").to_pylist()
                bounds, ids = encode_texts(pc.fill_null(part.column("text"), "").to_pylist(), path)
                for k, doc_id in enumerate(ids_of):
                    own = np.append(ids[bounds[k] : bounds[k + 1]], end).astype("<u4")
                    held[serial] = (doc_id, own, len(own))
                    fresh.append(serial)
                    serial += 1
                    ready += len(own)
                if ready >= BLOCK_TOKENS:
                    ready = 0
                    yield emit(False)
        yield emit(True)

    return arrow_map(docs.select("doc_id", "text"), run, SCHEMA)

