"""Byte-pair encoding over ragged numpy arrays.

``RaggedBpe`` holds many pre-tokens as one flat symbol array with row bounds. In each round every row
that can still merge applies its lowest-ranked pair, at all its places, left to right where they
overlap. A merge can only enable pairs of a higher rank, so rounds give the same symbols as merging
one pair at a time. ``Pretokens`` cuts texts of Latin-1 characters by table lookups; other texts go
through the pattern itself.
"""

from __future__ import annotations

import json
import unicodedata

import numpy as np
import pyarrow as pa
import regex

NONE = np.iinfo(np.int32).max
LETTER, NUMBER, OTHER, SPACE = range(4)
CONTRACTIONS = ("s", "t", "m", "d", "re", "ve", "ll")
BYTE_PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
WORD_PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: Longer pre-tokens are encoded by the library: a row needs a round for each rank it uses.
LONGEST = 400


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    out, extra = [""] * 256, 0
    for b in range(256):
        if b in plain:
            out[b] = chr(b)
        else:
            out[b], extra = chr(256 + extra), extra + 1
    return out


def latin1_classes() -> np.ndarray:
    table = np.full(256, OTHER, np.uint8)
    for b in range(256):
        kind = unicodedata.category(chr(b))[0]
        if kind == "L":
            table[b] = LETTER
        elif kind == "N":
            table[b] = NUMBER
        elif b in (0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0x85, 0xA0):
            table[b] = SPACE
    return table


CLASSES = latin1_classes()


def _contractions(data: np.ndarray, kind: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of an apostrophe that opens a contraction at the start of a pre-token, and the lengths."""
    at = np.flatnonzero((data == 0x27) & start)
    size = np.zeros(len(at), np.int64)
    padded = np.concatenate([data, np.zeros(3, np.uint8)])
    for tail in CONTRACTIONS:
        hit = np.ones(len(at), bool)
        for k, c in enumerate(tail.encode(), 1):
            hit &= padded[at + k] == c
        size[hit & (size == 0)] = len(tail) + 1
    return at[size > 0], size[size > 0]


def cut_bytes_style(data: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Starts of the pre-tokens of the byte-level pattern; they cover all of ``data``. first: starts of texts."""
    n = len(data)
    kind = CLASSES[data]
    fresh = np.zeros(n + 1, bool)
    fresh[first] = True
    fresh[n] = True
    change = np.empty(n, bool)
    change[0] = True
    change[1:] = kind[1:] != kind[:-1]
    change |= fresh[:n]
    space = kind == SPACE
    lead = np.zeros(n, bool)  # a blank that the next pre-token takes along
    last = space.copy()  # white space before something else in the same text
    last[:-1] &= ~space[1:]
    last &= ~fresh[1:]
    last[-1] = False
    lead[last] = data[last] == 0x20
    start = change.copy()
    start[last] = True
    after = np.zeros(n, bool)
    after[1:] = lead[:-1]
    start &= ~(after & ~space)
    # a contraction starts only where its apostrophe starts a pre-token
    at, size = _contractions(data, kind, start)
    if len(at):
        ends = np.searchsorted(first, at, side="right")
        bound = np.concatenate([first, [n]])[ends]
        ok = at + size <= bound
        at, size = at[ok], size[ok]
        start[at + 1] = False
        inside = at + size
        keep = inside < n
        start[inside[keep]] = True
        # the character after it may have been a blank's follower only if it is a letter, so it stands alone
    return np.flatnonzero(start)


def cut_words_style(data: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Starts for the word pattern: white space gets pieces of its own, which carry no ids."""
    n = len(data)
    kind = CLASSES[data]
    start = np.empty(n, bool)
    start[0] = True
    start[1:] = kind[1:] != kind[:-1]
    start[first[first < n]] = True
    start |= kind == NUMBER
    at, size = _contractions(data, kind, start)
    if len(at):
        bound = np.concatenate([first, [n]])[np.searchsorted(first, at, side="right")]
        ok = at + size <= bound
        at, size = at[ok], size[ok]
        start[at + 1] = False
        inside = at + size
        start[inside[inside < n]] = True
    return np.flatnonzero(start)


class RaggedBpe:
    """A byte-pair vocabulary of a ``tokenizers`` file, applied to many pre-tokens at once."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, symbols = spec["model"], byte_symbols()
        vocabulary, self.suffix = model["vocab"], model.get("end_of_word_suffix") or ""
        self.first = np.array([vocabulary[s] for s in symbols], np.int32)
        self.last = np.array([vocabulary[s + self.suffix] for s in symbols], np.int32)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        key = np.array([(vocabulary[a] << 20) | vocabulary[b] for a, b in pairs], np.int64)
        made = np.array([vocabulary[a + b if not self.suffix else a.removesuffix(self.suffix) + b] for a, b in pairs], np.int32)
        order = np.argsort(key, kind="stable")
        self.key, self.rank, self.made = key[order], order.astype(np.int32), made
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.path, self._library = path, None

    @property
    def library(self):
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self.path)
        return self._library

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = (left.astype(np.int64) << 20) | right
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.where(self.key[at] == key, self.rank[at], NONE)

    def encode(self, words: list[bytes] | pa.Array, latin1: bool, want_ids: bool) -> tuple[np.ndarray, np.ndarray]:
        """Ids of each pre-token: (bounds, ids); without ids, (bounds, empty). Words are UTF-8, or Latin-1 if so said."""
        words = words if isinstance(words, pa.Array) else pa.array(words, pa.binary())
        bounds = np.frombuffer(words.buffers()[1], np.int32, len(words) + 1, words.offset * 4).astype(np.int64) if len(words) else np.zeros(1, np.int64)
        raw = np.frombuffer(words.buffers()[2], np.uint8)[bounds[0] : bounds[-1]] if len(words) and words.buffers()[2] is not None else np.empty(0, np.uint8)
        bounds = bounds - bounds[0]
        if latin1 and (raw >= 0x80).any():
            wide = (raw >= 0x80).astype(np.int64)
            grown = np.concatenate([[0], np.cumsum(1 + wide)])
            out = np.empty(grown[-1], np.uint8)
            out[grown[:-1]] = np.where(wide, 0xC0 | (raw >> 6), raw)
            hit = np.flatnonzero(wide)
            out[grown[hit] + 1] = 0x80 | (raw[hit] & 0x3F)
            raw, bounds = out, grown[bounds]
        sizes = np.diff(bounds)
        counts = np.zeros(len(sizes), np.int64)
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        long = np.flatnonzero(sizes > LONGEST)
        for w in long.tolist():
            ids = self._by_library(raw[bounds[w] : bounds[w + 1]].tobytes())
            counts[w] = len(ids)
            if want_ids:
                parts.append((np.full(len(ids), w), ids))
        rows = np.flatnonzero((sizes > 0) & (sizes <= LONGEST))
        if len(rows):
            size = sizes[rows]
            ends = np.cumsum(size)
            begin = ends - size
            place = np.repeat(bounds[rows] - begin, size) + np.arange(ends[-1])
            symbol = self.first[raw[place]]
            symbol[ends - 1] = self.last[raw[place[ends - 1]]]
            self._merge(symbol, rows, begin, size, counts, parts if want_ids else None)
        bound = np.concatenate([[0], np.cumsum(counts)])
        if not want_ids or not parts:
            return bound, np.empty(0, np.int32)
        owner = np.concatenate([p[0] for p in parts])
        return bound, np.concatenate([p[1] for p in parts])[np.argsort(owner, kind="stable")]

    def _by_library(self, word: bytes) -> np.ndarray:
        symbols = byte_symbols()
        return np.array([t.id for t in self.library.model.tokenize("".join(symbols[b] for b in word))], np.int32)

    def _merge(self, symbol, rows, begin, size, counts, parts) -> None:
        """Rounds over rows given by (begin, size) in symbol; writes each finished row's count and ids."""
        rank = np.full(len(symbol), NONE, np.int32)
        rank[:-1] = self.ranks(symbol[:-1], symbol[1:])
        rank[begin + size - 1] = NONE
        while True:
            least = np.minimum.reduceat(rank, begin)
            done = least == NONE
            if done.any():
                counts[rows[done]] = size[done]
                held = np.repeat(done, size)
                if parts is not None:
                    parts.append((np.repeat(rows[done], size[done]), symbol[held]))
                symbol, rank = symbol[~held], rank[~held]
                rows, size, least = rows[~done], size[~done], least[~done]
                if not len(rows):
                    return
                begin = np.cumsum(size) - size
            row = np.repeat(np.arange(len(rows)), size)
            hit = np.flatnonzero(rank == least[row])
            # places that overlap follow each other; every second one of such a run merges
            new_run = np.empty(len(hit), bool)
            new_run[0] = True
            new_run[1:] = hit[1:] != hit[:-1] + 1
            if not new_run.all():
                run_at = np.flatnonzero(new_run)
                run = np.cumsum(new_run) - 1
                hit = hit[(np.arange(len(hit)) - run_at[run]) % 2 == 0]
            symbol[hit] = self.made[rank[hit]]
            keep = np.ones(len(symbol), bool)
            keep[hit + 1] = False
            size = size - np.bincount(row[hit], minlength=len(rows))
            moved = np.cumsum(keep) - 1
            symbol, rank, at = symbol[keep], rank[keep], moved[hit]
            begin = np.cumsum(size) - size
            stale = np.zeros(len(symbol), bool)
            stale[at] = True
            stale[at[at > 0] - 1] = True
            stale[begin + size - 1] = False
            near = np.flatnonzero(stale)
            rank[at] = NONE
            rank[near] = self.ranks(symbol[near], symbol[near + 1])


def latin1_parts(texts: list[str], special: list[str]) -> tuple[list[int], list[bytes], list[int]]:
    """Numbers and bytes of the texts of Latin-1 characters without special strings; the numbers of the others."""
    plain, data, rest = [], [], []
    for i, t in enumerate(texts):
        if any(s in t for s in special):
            rest.append(i)
            continue
        try:
            data.append(t.encode("latin-1"))
            plain.append(i)
        except UnicodeEncodeError:
            rest.append(i)
    return plain, data, rest


def dictionary(data: bytes, starts: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Codes and distinct pieces of data cut at starts."""
    offsets = np.append(starts, len(data)).astype(np.int32)
    pieces = pa.BinaryArray.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
    coded = pieces.dictionary_encode()
    return np.asarray(coded.indices), coded.dictionary
