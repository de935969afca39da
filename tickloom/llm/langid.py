"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary. A word's probability is
the sum over all ways to cut it into pieces, by the forward algorithm; a text's is the product over its
words. The piece probabilities are learned by expectation-maximisation over the same lattices, on a
bounded sample of labelled documents, of which every word counts. Words are runs of at most ``LONGEST`` letters of the lower-cased
text, longer runs being cut.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import arrow_map, crc_mod, slices

LONGEST = 24
#: Small slices keep the lattices in a core's cache.
SLICE = 1_000_000
#: Characters of the longest piece that the lattice can hold; no public vocabulary here has longer ones.
MOST_PIECE = 31
#: Distinct words that are fitted at a time.
FIT_WORDS = 20_000
WORD = re.compile(r"[^\W\d_]{1,%d}" % LONGEST)
MARK = "▁"
UNKNOWN = 1e-7
BASE = np.uint64(0x100000001B3)


@dataclass
class Training:
    """Bounds of the fit: labelled documents of each language; rounds, which end once the likelihood of a word gains less than ``tolerance``."""

    docs_per_language: int = 600
    rounds: int = 12
    tolerance: float = 1e-3
    smoothing: float = 0.02


def vocabulary(path: str) -> list[str]:
    """The pieces of a sentencepiece file that lower-cased letters can make."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found = {model.id_to_piece(i) for i in range(model.get_piece_size())}
    return sorted(p for p in found if (q := p.removeprefix(MARK)).isalpha() and q == q.lower() and len(p) <= MOST_PIECE or p == MARK)


class Lattice:
    """Finds the pieces in many words at once: a trie kept as sorted hashes of prefixes, one table a length."""

    def __init__(self, pieces: list[str]) -> None:
        self.n = len(pieces)
        levels: list[dict[int, int]] = [{} for _ in range(MOST_PIECE + 1)]
        for k, p in enumerate(pieces):
            h = 0
            for i, c in enumerate(p, 1):
                h = (h * int(BASE) + ord(c)) & 0xFFFFFFFFFFFFFFFF
                levels[i].setdefault(h, -1)
            levels[len(p)][h] = k
        self.levels = []
        for level in levels:
            keys = np.array(sorted(level), np.uint64)
            self.levels.append((keys, np.array([level[int(x)] for x in keys], np.int64)))

    def arcs(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray, int]]]:
        """(first node of each word, its length, arcs by end): arcs are (end node, piece, length), where piece n is unknown."""
        joined = MARK + MARK.join(words)
        codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32).astype(np.uint64)
        size = np.fromiter((len(w) + 1 for w in words), np.int64, len(words))
        begin = np.cumsum(size) - size
        left = np.repeat(begin + size, size) - np.arange(len(codes))  # characters to the word's end
        nodes = begin + np.arange(len(words))  # a word of n characters has n + 1 nodes
        node = np.arange(len(codes)) + np.repeat(np.arange(len(words)), size)
        place, h = np.arange(len(codes)), np.zeros(len(codes), np.uint64)
        ends, found, lengths = [], [], []
        with np.errstate(over="ignore"):
            for n in range(1, MOST_PIECE + 1):
                keys, piece = self.levels[n]
                if not len(place) or not len(keys):
                    break
                ok = left[place] >= n
                place, h = place[ok], h[ok]
                h = h * BASE + codes[place + n - 1]
                at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
                ok = keys[at] == h
                if n == 1:  # a character without a piece is one unknown arc
                    lost = place[~ok]
                    ends.append(node[lost] + 1), found.append(np.full(len(lost), self.n)), lengths.append(np.full(len(lost), 1, np.int64))
                place, h, at = place[ok], h[ok], at[ok]
                k = piece[at]
                full = k >= 0
                if n == 1:
                    k, full = np.where(full, k, self.n), np.ones(len(k), bool)
                ends.append(node[place[full]] + n), found.append(k[full]), lengths.append(np.full(int(full.sum()), n, np.int64))
        end, kind, length = np.concatenate(ends), np.concatenate(found), np.concatenate(lengths)
        first = np.repeat(nodes, size + 1)
        key = ((end - first[end]) * 32 + length).astype(np.int16)
        order = np.argsort(key, kind="stable")
        key, end, kind = key[order], end[order], kind[order]
        cuts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        groups = [(end[a:b], kind[a:b], int(key[a]) % 32) for a, b in zip(cuts, [*cuts[1:], len(key)], strict=True)]
        return nodes, size, groups


def forward(nodes: np.ndarray, size: np.ndarray, groups: list, p: np.ndarray) -> np.ndarray:
    """Sums over segmentations at every node, a row for each language; p: probabilities, a row for each language."""
    alpha = np.zeros((len(p), int(nodes[-1] + size[-1] + 1) if len(nodes) else 0))
    alpha[:, nodes] = 1.0
    for end, kind, length in groups:  # no two arcs of a group meet in a node
        start = end - length
        for a, q in zip(alpha, p, strict=True):
            a[end] += a[start] * q[kind]
    return alpha


def learn(lattice: Lattice, counts: dict[str, dict[str, int]], how: Training) -> tuple[list[str], np.ndarray]:
    """Languages and piece probabilities (languages by pieces and the unknown) from word counts by language."""
    langs, columns = sorted(counts), []
    for lang in langs:
        words = sorted(counts[lang])
        weight = np.array([counts[lang][w] for w in words], float)
        p = np.full(lattice.n + 1, 1.0 / lattice.n)
        p[lattice.n] = UNKNOWN
        likely = -np.inf
        for _ in range(how.rounds):
            expected, found = np.zeros(lattice.n + 1), 0.0
            for some in range(0, len(words), FIT_WORDS):
                nodes, size, groups = lattice.arcs(words[some : some + FIT_WORDS])
                times = weight[some : some + FIT_WORDS]
                alpha = forward(nodes, size, groups, p[None])[0]
                total = alpha[nodes + size]
                found += float(times @ np.log(total))
                beta = np.zeros(len(alpha))
                beta[nodes + size] = times / total
                for end, kind, length in reversed(groups):
                    part = beta[end] * p[kind]
                    expected += np.bincount(kind, alpha[end - length] * part, lattice.n + 1)
                    np.add.at(beta, end - length, part)
            expected[lattice.n] = 0.0
            p = (expected + how.smoothing) / (expected[: lattice.n].sum() + how.smoothing * lattice.n)
            p[lattice.n] = UNKNOWN
            if found - likely < how.tolerance * weight.sum():
                break
            likely = found
        columns.append(p)
    return langs, np.stack(columns) if columns else np.zeros((0, lattice.n + 1))


def word_counts(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """(text number, word code, words) of every word of some texts."""
    own = [WORD.findall(t.lower()) if t else [] for t in texts]
    flat = pa.array([w for ws in own for w in ws], pa.string()).dictionary_encode()
    return np.repeat(np.arange(len(texts)), [len(ws) for ws in own]), np.asarray(flat.indices), flat.dictionary.to_pylist()


def sample_counts(docs: DataFrame, how: Training) -> dict[str, dict[str, int]]:
    """Word counts by language over a hash sample of the training documents (see Training)."""
    rows = docs.where("lang is not null and text is not null").where(crc_mod("doc_id", 4) != 2).select("doc_id", "text", "lang")
    have = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not have:
        return {}
    share = F.element_at(F.create_map(*[F.lit(x) for k, n in sorted(have.items()) for x in (k, min(1.0, how.docs_per_language / n))]), F.col("lang"))
    draw = F.shiftrightunsigned(F.xxhash64(F.lit(11), "doc_id"), 11) / F.lit(float(1 << 53))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                doc, code, words = word_counts(part.column("text").to_pylist())
                lang = part.column("lang").dictionary_encode()
                key = np.asarray(lang.indices)[doc] * max(1, len(words)) + code
                key, n = np.unique(key, return_counts=True)
                yield pa.RecordBatch.from_arrays([lang.dictionary.take(pa.array(key // max(1, len(words)))).cast(pa.string()), pa.array([words[k] for k in key % max(1, len(words))], pa.string()), pa.array(n, pa.int64())], names=["lang", "word", "n"])

    counted = arrow_map(rows.where(draw < share).select("lang", "text"), run, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    out: dict[str, dict[str, int]] = {}
    for r in counted.select("lang", "word", "n").toLocalIterator():  # the words of the bounded sample
        if r["word"].isalpha():
            out.setdefault(r["lang"], {})[r["word"]] = r["n"]
    return out


class Scorer:
    def __init__(self, pieces: list[str], langs: list[str], p: np.ndarray) -> None:
        self.lattice, self.langs, self.p = Lattice(pieces), langs, p

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language and posterior (under equal priors) of each text."""
        doc, code, words = word_counts(texts)
        clean = ["".join(c for c in w if c.isalpha()) if not w.isalpha() else w for w in words]
        letters = np.array([bool(w) for w in clean], bool)
        if not len(code) or not self.langs or not letters.any():
            return ["und"] * len(texts), np.zeros(len(texts))
        nodes, size, groups = self.lattice.arcs(clean)
        score = np.log(forward(nodes, size, groups, self.p)[:, nodes + size])
        score[:, ~letters] = 0.0
        n = len(texts)
        total = np.stack([np.bincount(doc, score[k, code], n) for k in range(len(self.langs))], axis=1)
        seen = np.bincount(doc, letters[code], n) > 0
        best = total.argmax(axis=1)
        share = 1.0 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
        return [self.langs[k] if s else "und" for k, s in zip(best.tolist(), seen.tolist(), strict=True)], np.where(seen, share, 0.0)


def fitted(docs: DataFrame, path: str, how: Training | None = None) -> tuple[list[str], list[str], np.ndarray]:
    pieces = vocabulary(path)
    langs, p = learn(Lattice(pieces), sample_counts(docs, how or Training()), how or Training())
    return pieces, langs, p


def identify(docs: DataFrame, path: str, how: Training | None = None) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score.

    score is the posterior of the predicted language. A text that is null or has no letters gets
    "und" and 0, as does every text if no document is labelled. held_out is null for a null doc_id, which
    is not learned from. Languages that tie go by name. Texts of any length count whole, one at a time
    if they are large. An empty table gives no rows. Repeated rows get a row each. Extra columns are ignored. The model
    that is broadcast has the vocabulary's size times the number of languages.
    """
    model = docs.sparkSession.sparkContext.broadcast(fitted(docs, path, how))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = None
        for batch in batches:
            scorer = scorer or Scorer(*model.value)
            for part in slices(batch, most=SLICE):
                langs, score = scorer.predict(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(langs, pa.string()), pa.array(score)], names=["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (crc_mod("doc_id", 4) == 2).alias("held_out"), "text")
    return arrow_map(rows, run, "doc_id long, held_out boolean, lang_pred string, score double")


def keep_identified(docs: DataFrame, path: str, least: float = 0.5, how: Training | None = None) -> DataFrame:
    """The documents, with all their columns, whose language is found with a posterior of at least ``least``."""
    model = docs.sparkSession.sparkContext.broadcast(fitted(docs, path, how))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = None
        for batch in batches:
            scorer = scorer or Scorer(*model.value)
            for part in slices(batch, most=SLICE):
                langs, score = scorer.predict(part.column("text").to_pylist())
                yield part.filter(pa.array([k != "und" and s >= least for k, s in zip(langs, score.tolist(), strict=True)], pa.bool_()))

    return arrow_map(docs, run, docs.schema)
