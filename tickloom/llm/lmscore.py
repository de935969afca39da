"""Language-model scores by a Brown class-based bigram model.

The most frequent words of the whole corpus are its head. Exchange clustering deals the first of them,
with pools of the other words by their last two bytes, to classes so that the class bigrams keep the
most mutual information. Every other head word then gets the class that gains most, by the counts of
the classes before and after it in the corpus. Only words outside the head keep their pool's class. A
token's probability is that of its class after the previous one, times that of the word within its
class.

Counts cover the whole corpus. The head is counted in arrays and broadcast; other words are counted in a
table that their occurrences are joined to, so no vocabulary is ever collected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import Words, arrow_map, checkpointed, crc_mod, slices


@dataclass
class Settings:
    """Bounds of what the driver holds and broadcasts, and of the model."""

    head: int = 32_768  # words with a class by their own contexts
    symbols: int = 1024  # of these, words that the exchange moves until nothing gains
    pools: int = 128
    classes: int = 48
    rounds: int = 12
    mixed: float = 0.9  # share of the class bigram; the rest is the class unigram


def pool_of(words: pa.Array, pools: int) -> np.ndarray:
    """A pool for each word by its last two bytes."""
    if not len(words):
        return np.empty(0, np.int64)
    words = words.cast(pa.binary())
    ends = np.frombuffer(words.buffers()[1], np.int32, len(words) + 1, words.offset * 4)
    data = np.frombuffer(words.buffers()[2], np.uint8)
    last = data[ends[1:] - 1].astype(np.int64)
    before = np.where(np.diff(ends) > 1, data[np.maximum(ends[1:] - 2, 0)], 0).astype(np.int64)
    return (last * 31 + before * 7) % pools


class Symbols:
    """Numbers for words: heads by rank, -1 otherwise; and symbols: own ones, then pools, then the end."""

    def __init__(self, head: list[str], how: Settings) -> None:
        self.head, self.how = pa.array(head, pa.string()), how
        self.own = min(how.symbols, len(head))
        self.end = self.own + how.pools
        self.count = self.end + 1

    def of(self, vocabulary: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        number = np.asarray(pc.fill_null(pc.index_in(vocabulary, value_set=self.head), -1)).astype(np.int64)
        symbol = np.where((number >= 0) & (number < self.own), number, self.own + pool_of(vocabulary, self.how.pools))
        return number, symbol


def with_ends(words: Words, values: np.ndarray, end) -> np.ndarray:
    """Values of the words of every text in order, each text followed by ``end``."""
    out = np.full(len(values) + len(words.offsets) - 1, end, values.dtype)
    place = np.arange(len(values)) + words.doc_of()
    out[place] = values
    return out


def word_totals(rows: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                words = Words(part.column("text"), lower=True)
                yield pa.RecordBatch.from_arrays([words.vocabulary, pa.array(np.bincount(words.codes, minlength=len(words.vocabulary)))], names=["word", "n"])

    return arrow_map(rows.select("text"), run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def tail_pools(totals: DataFrame, symbols: Symbols) -> tuple[np.ndarray, np.ndarray]:
    """Tokens and distinct words outside the head, by symbol."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            number, symbol = symbols.of(batch.column("word"))
            tail = number < 0
            tokens = np.bincount(symbol[tail], np.asarray(batch.column("n"))[tail], symbols.count).astype(np.int64)
            words = np.bincount(symbol[tail], minlength=symbols.count)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(symbols.count)), pa.array(tokens), pa.array(words)], names=["symbol", "tokens", "words"])

    found = arrow_map(totals, run, "symbol long, tokens long, words long").groupBy("symbol").agg(F.sum("tokens").alias("tokens"), F.sum("words").alias("words"))
    out = np.zeros((2, symbols.count), np.int64)
    for r in found.collect():  # a row for each symbol
        out[:, r["symbol"]] = r["tokens"], r["words"]
    return out[0], out[1]


def bigrams(train: DataFrame, symbols: Symbols, of: np.ndarray | None, of_head: np.ndarray | None) -> np.ndarray:
    """Counts of pairs (from, to) in the corpus: of symbols, or of classes if these are given for symbols and head words."""
    size = symbols.count if of is None else int(of.max()) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = np.zeros(size * size, np.int64)
        for batch in batches:
            for part in slices(batch):
                words = Words(part.column("text"), lower=True)
                kind, end = _kinds(words, symbols, of, of_head)
                line = with_ends(words, kind[words.codes], end)
                before = np.concatenate([[end], line[:-1]])
                pairs += np.bincount(before * size + line, minlength=size * size)
        full = np.flatnonzero(pairs)
        yield pa.RecordBatch.from_arrays([pa.array(full), pa.array(pairs[full])], names=["key", "n"])

    table = arrow_map(train.select("text"), run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(size * size, np.int64)
    out[np.asarray(table.column("key"))] = np.asarray(table.column("n"))
    return out.reshape(size, size)


def _kinds(words: Words, symbols: Symbols, of: np.ndarray | None, of_head: np.ndarray | None) -> tuple[np.ndarray, int]:
    """The symbol or class of each word of the vocabulary, and of the end."""
    number, symbol = symbols.of(words.vocabulary)
    if of is None:
        return symbol, symbols.end
    return (np.where(number >= 0, np.append(of_head, 0)[number], of[symbol]) if of_head is not None else of[symbol]), int(of[symbols.end])


def _f(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def best_class(into: np.ndarray, out: np.ndarray, table: np.ndarray, now: np.ndarray) -> np.ndarray:
    """The class that each word gains most in; into, out: its counts after and before each class; now: the class that has counted it so far.

    The last class belongs to the end alone.
    """
    k, count = len(now), len(table)
    rest = np.repeat(table[None].astype(float), k, axis=0)
    at = np.arange(k)
    rest[at, now] -= out
    rest[at, :, now] -= into
    np.maximum(rest, 0.0, out=rest)
    left, right = rest.sum(axis=2), rest.sum(axis=1)
    gain = (_f(rest + out[:, None, :]) - _f(rest)).sum(axis=2) + (_f(rest + into[:, :, None]) - _f(rest)).sum(axis=1)
    gain -= _f(left + out.sum(axis=1, keepdims=True)) - _f(left) + _f(right + into.sum(axis=1, keepdims=True)) - _f(right)
    gain[:, count - 1] = -np.inf
    return np.where(gain.max(axis=1) > gain[at, now] + 1e-9, gain.argmax(axis=1), now)


def head_classes(train: DataFrame, symbols: Symbols, of: np.ndarray, table: np.ndarray) -> np.ndarray:
    """A class for each head word: the exchange's for those with symbols of their own, else the one that gains most.

    Contexts are counted over the whole corpus and stay in the cluster; a row for each word comes back.
    """
    heads, own, count = len(symbols.head), symbols.own, len(table)
    _, symbol = symbols.of(symbols.head) if heads else (None, np.empty(0, np.int64))
    start = of[symbol]
    if heads == own:
        return start

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros((heads - own) * 2 * count, np.int32)
        for batch in batches:
            for part in slices(batch):
                words = Words(part.column("text"), lower=True)
                number, kind = symbols.of(words.vocabulary)[0], _kinds(words, symbols, of, None)[0]
                line = with_ends(words, kind[words.codes], np.int64(of[symbols.end]))
                who = with_ends(words, number[words.codes], np.int64(-1))
                at = np.flatnonzero(who >= own)
                before = np.concatenate([[of[symbols.end]], line[:-1]])[at]
                key = (who[at] - own) * 2 * count
                for keys in (key + before, key + count + line[at + 1]):
                    keys, n = np.unique(keys, return_counts=True)
                    found[keys] += n.astype(np.int32)
        full = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array((full // (2 * count)).astype(np.int32)), pa.array((full % (2 * count)).astype(np.int32)), pa.array(found[full].astype(np.int64))], names=["word", "key", "n"])

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 128):
                part = batch.slice(a, 128)
                word = np.asarray(part.column("word"))
                counts = np.zeros((len(word), 2 * count))
                sizes = np.asarray(pc.list_value_length(part.column("seen")))
                seen = part.column("seen").flatten()
                counts[np.repeat(np.arange(len(word)), sizes), np.asarray(seen.field("key"))] = np.asarray(seen.field("n"))
                best = best_class(counts[:, :count], counts[:, count:], table, start[own + word])
                yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(best.astype(np.int32))], names=["word", "class"])

    seen = arrow_map(train.select("text"), contexts, "word int, key int, n long").groupBy("word", "key").agg(F.sum("n").alias("n"))
    seen = seen.groupBy("word").agg(F.collect_list(F.struct("key", "n")).alias("seen"))  # at most two counts a class
    told = arrow_map(seen, assign, "word int, class int").toArrow()
    out = start.copy()
    out[own + np.asarray(told.column("word"))] = np.asarray(told.column("class"))
    return out


def exchange(pairs: np.ndarray, classes: int, rounds: int) -> np.ndarray:
    """A class for each symbol, the last symbol (the end) alone in the last class, by exchange clustering."""
    size = len(pairs)
    total = pairs.sum(axis=0) + pairs.sum(axis=1)
    order = [s for s in np.lexsort((np.arange(size), -total)).tolist() if s != size - 1]
    of = np.zeros(size, np.int64)
    for r, s in enumerate(order):
        of[s] = r % classes
    of[size - 1] = classes
    count = classes + 1
    table = np.zeros((count, count))
    np.add.at(table, (of[:, None], of[None, :]), pairs)

    for _ in range(rounds):
        moved = 0
        for s in order:
            if not total[s]:
                break
            a = of[s]
            out = np.bincount(of, pairs[s], count)
            into = np.bincount(of, pairs[:, s], count)
            own = float(pairs[s, s])
            out[a] -= own
            into[a] -= own
            table[a] -= out
            table[:, a] -= into
            table[a, a] -= own
            left, right = table.sum(axis=1) + into, table.sum(axis=0) + out  # whichever class it joins
            gain = (_f(table + out[None, :]) - _f(table)).sum(axis=1) + (_f(table + into[:, None]) - _f(table)).sum(axis=0)
            own_cell = np.diag(table)
            gain += _f(own_cell + out + into + own) + _f(own_cell) - _f(own_cell + out) - _f(own_cell + into)
            gain -= _f(left + out.sum() + own) - _f(left) + _f(right + into.sum() + own) - _f(right)
            gain[classes] = -np.inf
            b = int(gain.argmax())
            if gain[b] <= gain[a] + 1e-9:
                b = a
            moved += b != a
            of[s] = b
            table[b] += out
            table[:, b] += into
            table[b, b] += own
        if not moved:
            break
    return of


def tail_rows(rows: DataFrame, symbols: Symbols) -> DataFrame:
    """(row, tkey, word, n) for every word outside the head of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                words = Words(part.column("text"), lower=True)
                number, _ = symbols.of(words.vocabulary)
                at = np.flatnonzero(number[words.codes] < 0)
                key, n = np.unique(words.doc_of()[at] * max(1, len(number)) + words.codes[at], return_counts=True)
                doc, code = key // max(1, len(number)), key % max(1, len(number))
                take = pa.array(doc)
                yield pa.RecordBatch.from_arrays([*(part.column(c).take(take) for c in ("row", "tkey")), words.vocabulary.take(pa.array(code)), pa.array(n.astype(np.int32))], names=["row", "tkey", "word", "n"])

    return arrow_map(rows.select("row", "tkey", "text"), run, "row long, tkey long, word string, n int")


def tail_scores(rows: DataFrame, symbols: Symbols, totals: DataFrame) -> DataFrame:
    """(row, tkey) with sums over its tail tokens: x of log10(count + 0.5), known and n.

    Both sides of the join are dealt for it alone, so a word of very many texts can be split.
    """
    found = tail_rows(rows, symbols).join(totals.select("word", F.col("n").alias("c")), "word", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    return found.groupBy("row", "tkey").agg(F.sum(F.col("n") * F.log10(F.col("c") + 0.5)).alias("x"), F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("known"), F.sum("n").alias("n"))


@dataclass
class Model:
    symbols: Symbols
    head_log: np.ndarray  # log10(count + 0.5) of head words
    head_known: np.ndarray
    of: np.ndarray  # class of each symbol
    of_head: np.ndarray  # class of each head word
    step: np.ndarray  # log10 P(class | previous class)
    room: np.ndarray  # log10 of each class's denominator
    end_log: float
    end_known: int
    tokens: int
    base_room: float


def _least_count(totals: DataFrame, most: int) -> int:
    """The smallest count that at most ``most`` words exceed: a row for each distinct count comes to the driver."""
    words, least = 0, 0
    for r in sorted(totals.groupBy("n").agg(F.count(F.lit(1)).alias("words")).collect(), key=lambda r: -r["n"]):
        words += r["words"]
        if words > most:
            least = r["n"]
            break
    return least


def learn(train: DataFrame, totals: DataFrame, how: Settings) -> Model:
    """The model of some texts; totals: (word, n) of all their words."""
    texts = train.count()
    sums = totals.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("words")).first()
    tokens, vocabulary = (sums["n"] or 0) + texts, sums["words"] + (texts > 0)
    head = sorted(totals.where(F.col("n") > _least_count(totals, how.head)).collect(), key=lambda r: (-r["n"], r["word"]))
    heads = np.array([r["n"] for r in head], np.int64)
    symbols = Symbols([r["word"] for r in head], how)
    rest, distinct = tail_pools(totals, symbols)
    of = exchange(bigrams(train, symbols, None, None), how.classes, how.rounds)
    of_head = head_classes(train, symbols, of, bigrams(train, symbols, of, None))
    # classes: tokens and distinct words of each, and steps between them
    classes = how.classes + 1
    steps = bigrams(train, symbols, of, of_head).astype(float)
    size = np.bincount(of_head, heads, classes) + np.bincount(of, rest, classes)
    kinds = np.bincount(of_head, minlength=classes) + np.bincount(of, distinct, classes)
    room = np.log10(size + 0.5 * (kinds + 1))
    size[how.classes] += texts
    alone = (size + 0.5) / (size.sum() + 0.5 * classes)
    after = steps.sum(axis=1, keepdims=True)
    step = np.log10(np.where(after > 0, how.mixed * steps / np.maximum(after, 1), how.mixed * alone) + (1 - how.mixed) * alone)
    room[how.classes] = 0.0  # the end is its class's only word
    return Model(symbols, np.log10(heads + 0.5), np.ones(len(heads), np.int64), of, of_head, step, room, float(np.log10(texts + 0.5)), int(texts > 0), int(tokens), float(np.log10(tokens + 0.5 * (vocabulary + 1))))


def _score_texts(rows: DataFrame, model) -> DataFrame:
    """Sums over each text's tokens that need no shuffle: everything but its tail words' counts."""
    schema = "doc_id long, held_out boolean, row long, tkey long, n_tokens long, n_tail long, head_known long, head_log double, step double, room double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in batches:
            for part in slices(batch):
                words = Words(part.column("text"), lower=True)
                number, _ = m.symbols.of(words.vocabulary)
                head = number >= 0
                log = np.where(head, np.append(m.head_log, 0.0)[number], 0.0)[words.codes]
                known = np.where(head, np.append(m.head_known, 0)[number], 0)[words.codes]
                doc, n = words.doc_of(), part.num_rows
                kind, end = _kinds(words, m.symbols, m.of, m.of_head)
                line = with_ends(words, kind[words.codes], end)
                before = np.concatenate([[end], line[:-1]])
                size = words.counts + 1
                owner = np.repeat(np.arange(n), size)
                sums = [np.bincount(owner, x, n) for x in (m.step[before, line], m.room[line])]
                tail = np.bincount(doc, ~head[words.codes], n).astype(np.int64)
                yield pa.RecordBatch.from_arrays([
                    *(part.column(c) for c in ("doc_id", "held_out", "row", "tkey")), pa.array(size), pa.array(tail),
                    pa.array(np.bincount(doc, known, n).astype(np.int64) + m.end_known), pa.array(np.bincount(doc, log, n)), *map(pa.array, sums),
                ], names=[f.split(" ")[0] for f in schema.split(", ")])

    return arrow_map(rows.select("doc_id", "held_out", "row", "tkey", "text"), run, schema)


def lm_scores(docs: DataFrame, how: Settings | None = None) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Both scores are log10 probabilities of the whole text and its end. A null text is empty: one token,
    its end. A null doc_id has a null held_out, is scored, and is not learned from. Repeated rows get a
    row each. Words that tie in count with the first one beyond the head are not of the head. With nothing to learn from, every token is
    unknown. Texts of any length count whole, one at a time if they are large. An empty table gives no
    rows. Extra columns are ignored.
    """
    how = how or Settings()
    part = crc_mod("doc_id", 5)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (part == 1).alias("held_out"), F.coalesce(part != 1, F.lit(False)).alias("train"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)).alias("row"))
    rows = rows.withColumn("tkey", F.xxhash64("text"))
    train = rows.where("train")
    totals = checkpointed(word_totals(train))
    found = learn(train, totals, how)
    model = docs.sparkSession.sparkContext.broadcast(found)
    tail = tail_scores(rows, found.symbols, totals)
    joined = _score_texts(rows, model).join(tail, ["row", "tkey"], "left")
    # repeated rows have all put their tail tokens into one sum
    tail_log = F.coalesce(F.col("x") * F.col("n_tail") / F.col("n"), F.lit(0.0))
    tail_known = F.coalesce((F.col("known") * F.col("n_tail") / F.col("n")).cast("long"), F.lit(0))
    words_log = F.col("head_log") + tail_log
    return joined.select(
        "doc_id", "held_out", "n_tokens", (F.col("head_known") + tail_known).cast("long").alias("n_known"), F.lit(found.tokens).cast("long").alias("train_tokens"),
        (words_log + F.lit(found.end_log) - F.col("n_tokens") * F.lit(found.base_room)).alias("base_score"), (words_log + F.col("step") - F.col("room")).alias("score"),
    )
