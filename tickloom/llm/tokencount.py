"""Token counts by rank-synchronous merging of ragged arrays (see bpe.py)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from . import bpe
from .text import arrow_map, slices

SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
_ENGINES: dict[str, bpe.RaggedBpe] = {}


def engine(path: str) -> bpe.RaggedBpe:
    if path not in _ENGINES:
        _ENGINES[path] = bpe.RaggedBpe(path)
    return _ENGINES[path]


def count_texts(texts: list[str], path: str) -> np.ndarray:
    """Tokens of each text as the byte-level tokenizer file gives them, special strings as it takes them."""
    model = engine(path)
    out = np.zeros(len(texts), np.int64)
    plain, data, rest = bpe.latin1_parts(texts, model.special)
    sizes = np.array([len(d) for d in data], np.int64)
    joined = b"".join(data)
    if joined:
        full = np.flatnonzero(sizes > 0)
        first = (np.cumsum(sizes) - sizes)[full]
        starts = bpe.cut_bytes_style(np.frombuffer(joined, np.uint8), first)
        codes, words = bpe.dictionary(joined, starts)
        bound, _ = model.encode(words, latin1=True, want_ids=False)
        each = np.diff(bound)[codes]
        out[np.array(plain)[full]] = np.add.reduceat(each, np.searchsorted(starts, first))
    if rest:
        pieces: dict[bytes, int] = {}
        rows = []
        split = bpe.regex.compile("|".join(bpe.regex.escape(s) for s in model.special)) if model.special else None
        for i in rest:
            parts = split.split(texts[i]) if split else [texts[i]]
            out[i] = len(parts) - 1
            rows.append((i, [pieces.setdefault(w.encode(), len(pieces)) for p in parts for w in bpe.BYTE_PATTERN.findall(p)]))
        each = np.diff(model.encode(list(pieces), latin1=False, want_ids=False)[0])
        for i, own in rows:
            out[i] += int(each[own].sum()) if own else 0
    return out


def token_counts(docs: DataFrame, path: str, limit: int = 512) -> DataFrame:
    """One row per document with its UTF-8 bytes and tokens.

    A null text counts as empty: 0 bytes, 0 tokens. Rows that repeat, and null ids, each give a row of
    their own. Extra columns are ignored. No shuffle; memory is bounded by a slice of a batch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                texts = pc.fill_null(part.column("text"), "")
                n = count_texts(texts.to_pylist(), path)
                size = np.asarray(pc.binary_length(texts)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), pa.array(size), pa.array(n), pa.array(n > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return arrow_map(docs.select("doc_id", "text"), run, SCHEMA)
