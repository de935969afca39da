"""Mixing sources to target weights by iterative proportional fitting, in DataFrame functions only.

Documents fall into cells of source, language and topic. A cell's tokens are scaled by one factor for
each of its three labels until the three marginals meet their targets. With few pairs of language and
topic, their factors live on the driver while those of the sources, which may be many, are made where
the rows are: a round is one aggregation, to one row per language and topic, over a table with one row
per source. With many pairs all three factors are made in tables, to the same weights. Documents are
then drawn with the probability that their cell's weight asks for; the scale is solved for the share of
tokens to keep, with probabilities capped at 1, so a tiny cell that wants more than it has is kept whole
and takes nothing from the others.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import checkpointed

TOPICS = ("table", "marked", "caps", "long", "short")
#: Up to so many pairs of language and topic the driver holds their factors; beyond, tables do.
MOST_PAIRS = 2048
#: Up to so many cells (about 100 bytes each) the weights are broadcast; beyond, they are joined by a shuffle.
MOST_BROADCAST = 20_000


@dataclass
class Mix:
    """Targets: an exponent tempers the token shares found; explicit shares override it for a marginal.

    keep is the share of all tokens that the drawn documents hold in expectation.
    """

    source_power: float = 0.7
    lang_power: float = 0.7
    topic_power: float = 0.8
    source_shares: dict[str, float] = field(default_factory=dict)
    lang_shares: dict[str, float] = field(default_factory=dict)
    topic_shares: dict[str, float] = field(default_factory=dict)
    keep: float = 0.6
    seed: int = 20
    rounds: int = 60
    tolerance: float = 1e-7


def n_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def topic_of(text: Column, tokens: Column) -> Column:
    """The form of a text, as a stand-in for a topic model: by tables, marker runs, capitals and length."""
    text = F.coalesce(text, F.lit(""))
    count = lambda p: F.regexp_count(text, F.lit(p))
    return (
        F.when(count(r" \| ") * 4 > tokens, "table").when(count(r"[#$%&*]{3}") * 4 > tokens, "marked")
        .when(count(r"\p{Lu}{2,}") * 2 > tokens, "caps").when(tokens >= 300, "long").otherwise("short")
    )


def _labels(docs: DataFrame, topic: Column | None) -> DataFrame:
    """Each row as a struct, with its labels and tokens; a null label is a label of its own, null."""
    rows = docs.select(F.struct("*").alias("row"))
    rows = rows.withColumn("tokens", n_words(F.col("row.text")))
    label = topic if topic is not None else topic_of(F.col("row.text"), F.col("tokens"))
    return rows.select("row", "tokens", F.col("row.source").cast("string").alias("src"), F.col("row.lang").cast("string").alias("lng"), label.cast("string").alias("top"))


def _want(label: Column, found: Column, power: float, stated: dict[str, float]) -> Column:
    """The target of a label, up to a common factor: the share stated for it, else its tempered tokens."""
    raw = F.when(found > 0, F.pow(found.cast("double"), F.lit(power))).otherwise(0.0)
    for name, share in sorted(stated.items()):
        raw = F.when(label.eqNullSafe(F.lit(name)), F.lit(float(share))).otherwise(raw)
    return raw


def _targets(cells: DataFrame, mix: Mix, label: str) -> DataFrame:
    """(label, want): targets of one marginal that add up to 1."""
    power, stated = {"src": (mix.source_power, mix.source_shares), "lng": (mix.lang_power, mix.lang_shares), "top": (mix.topic_power, mix.topic_shares)}[label]
    found = cells.groupBy(label).agg(F.sum("t").alias("t")).withColumn("want", _want(F.col(label), F.col("t"), power, stated))
    total = found.agg(F.sum("want")).first()[0] or 1.0
    return found.select(label, (F.col("want") / F.lit(float(total))).alias("want"))


def _pick(lng: Column, top: Column, b: dict, c: dict) -> Column:
    """The product of the factors of a language and a topic."""

    def one(label: Column, factors: dict) -> Column:
        pairs = [F.lit(x) for kv in sorted((k, v) for k, v in factors.items() if k is not None) for x in kv]
        known = F.element_at(F.create_map(*pairs), label) if pairs else F.lit(None).cast("double")
        return F.coalesce(known, F.when(label.isNull(), F.lit(factors.get(None, 0.0))), F.lit(0.0))

    return one(lng, b) * one(top, c)


def _same(left: DataFrame, right: DataFrame, labels: list[str]) -> Column:
    out = left[labels[0]].eqNullSafe(right[labels[0]])
    for x in labels[1:]:
        out &= left[x].eqNullSafe(right[x])
    return out


def _rake_on_driver(cells: DataFrame, mix: Mix, total: float) -> DataFrame:
    """Weighted cells (src, lng, top, t, weight); languages and topics are few."""
    # one row per source: its target and its cells, of which there are at most languages x topics
    by_source = cells.groupBy("src").agg(F.collect_list(F.struct("lng", "top", "t")).alias("cells"))
    want = _targets(cells, mix, "src")
    sources = checkpointed(by_source.join(want, _same(by_source, want, ["src"])).select(by_source["src"], "want", "cells"))
    langs, topics = ({r[0]: r["want"] for r in _targets(cells, mix, x).collect()} for x in ("lng", "top"))
    b, c = dict.fromkeys(langs, 1.0), dict.fromkeys(topics, 1.0)

    def with_factor() -> DataFrame:
        """a: the source's factor, given those of languages and topics."""
        part = F.aggregate("cells", F.lit(0.0), lambda s, x: s + x["t"] * _pick(x["lng"], x["top"], b, c))
        return sources.withColumn("a", F.when(part > 0, F.col("want") * F.lit(total) / part).otherwise(0.0))

    for _ in range(mix.rounds):
        table = with_factor().select("a", F.explode("cells").alias("c")).groupBy("c.lng", "c.top").agg(F.sum(F.col("a") * F.col("c.t")).alias("m")).collect()
        m = {(r["lng"], r["top"]): r["m"] for r in sorted(table, key=lambda r: (str(r["lng"]), str(r["top"])))}
        off = max((abs(sum(v * b[l] * c[k] for (l, k), v in m.items() if l == x) - langs[x] * total) for x in langs), default=0.0) / (total or 1)
        if off < mix.tolerance:
            break
        for _ in range(200):  # languages and topics in turn, for these sources' factors
            before = dict(b)
            for x in langs:
                part = sum(v * c[k] for (l, k), v in m.items() if l == x)
                b[x] = langs[x] * total / part if part else 0.0
            for x in topics:
                part = sum(v * b[l] for (l, k), v in m.items() if k == x)
                c[x] = topics[x] * total / part if part else 0.0
            if all(abs(b[x] - before[x]) <= 1e-12 * max(1.0, b[x]) for x in b):
                break
    told = with_factor().select("src", "a", F.explode("cells").alias("c"))
    return told.select("src", "c.lng", "c.top", "c.t", (F.col("a") * _pick(F.col("c.lng"), F.col("c.top"), b, c)).alias("weight"))


def _rake_in_tables(cells: DataFrame, mix: Mix, total: float) -> DataFrame:
    """As ``_rake_on_driver`` for any number of languages and topics: a round scales the cells to one marginal after another."""
    wants = {x: checkpointed(_targets(cells, mix, x)) for x in ("src", "lng", "top")}
    cells = cells.withColumn("weight", F.lit(1.0))
    for _ in range(mix.rounds):
        off = 0.0
        for x in ("lng", "top", "src"):
            have = cells.groupBy(x).agg(F.sum(F.col("t") * F.col("weight")).alias("have"))
            told = have.join(wants[x], _same(have, wants[x], [x])).select(have[x].alias("of"), (F.col("want") * F.lit(total)).alias("want"), "have")
            told = checkpointed(told.withColumn("factor", F.when(F.col("have") > 0, F.col("want") / F.col("have")).otherwise(0.0)))
            off = max(off, told.agg(F.max(F.abs(F.col("have") - F.col("want")))).first()[0] or 0.0)
            cells = checkpointed(cells.join(told, cells[x].eqNullSafe(told["of"])).select("src", "lng", "top", "t", (F.col("weight") * F.col("factor")).alias("weight")))
        if off < mix.tolerance * total:
            break
    return cells


def fit(narrow: DataFrame, mix: Mix) -> tuple[DataFrame, float]:
    """Rake the token sums of (src, lng, top, tokens) to the targets: cells (src, lng, top, t, weight), and the sampling scale.

    The scale makes the tokens drawn ``mix.keep`` of all in expectation, where no probability (weight
    times scale) passes 1. If the targets contradict the empty cells, the last round's weights stand.
    """
    cells = checkpointed(narrow.groupBy("src", "lng", "top").agg(F.sum("tokens").alias("t")))
    total = float(cells.agg(F.sum("t")).first()[0] or 0)
    few = cells.select("lng", "top").distinct().count() <= MOST_PAIRS
    cells = checkpointed((_rake_on_driver if few else _rake_in_tables)(cells, mix, total))
    scale = mix.keep
    while True:  # every round finds more cells that are kept whole, until the scale fits the others
        whole = F.col("weight") * F.lit(scale) >= 1
        got = cells.agg(F.sum(F.when(whole, F.col("t"))).alias("whole"), F.sum(F.when(~whole, F.col("t") * F.col("weight"))).alias("rest")).first()
        new = (mix.keep * total - (got["whole"] or 0)) / got["rest"] if got["rest"] else scale
        if new <= scale * (1 + 1e-12):
            return cells, scale
        scale = new


def _drawn(docs: DataFrame, mix: Mix, topic: Column | None) -> DataFrame:
    rows = _labels(docs, topic)
    cells, scale = fit(rows.select("src", "lng", "top", "tokens"), mix)
    weights = cells.select(F.struct(F.lit(0).alias("k"), "src", "lng", "top").alias("cell"), "weight")
    if weights.count() <= MOST_BROADCAST:
        weights = F.broadcast(weights)
    # one struct holds the labels, so a null is a value like others
    joined = rows.join(weights, F.struct(F.lit(0).alias("k"), rows["src"], rows["lng"], rows["top"]) == F.col("cell"), "left")
    joined = joined.withColumn("probability", F.least(F.lit(1.0), F.col("weight") * F.lit(scale)))
    draw = F.shiftrightunsigned(F.xxhash64(F.lit(mix.seed), F.col("row.doc_id"), F.col("tokens")), 11) / F.lit(float(1 << 53))
    return joined.withColumn("kept", draw < F.col("probability"))


def mix_documents(docs: DataFrame, mix: Mix | None = None, topic: Column | None = None) -> DataFrame:
    """One row per document: doc_id, source, lang, topic, n_tokens, weight, probability, kept.

    weight is the target tokens per token of the document's cell; probability is weight times one scale,
    at most 1. The tokens drawn are ``Mix.keep`` of all in expectation, and meet the three marginals but
    for the cells that are kept whole and would need more than they have. A null source, language or
    topic is a label of its own; a null text is empty. Texts without words draw with their cell's
    probability, 0 if the cell has no tokens. The draw hashes doc_id and the tokens, so repeated rows
    are drawn alike; texts of any length count whole. An empty table gives no rows. Extra columns are
    ignored.
    """
    drawn = _drawn(docs, mix or Mix(), topic)
    return drawn.select(F.col("row.doc_id").alias("doc_id"), F.col("src").alias("source"), F.col("lng").alias("lang"), F.col("top").alias("topic"), F.col("tokens").alias("n_tokens"), "weight", "probability", "kept")


def sample_documents(docs: DataFrame, mix: Mix | None = None, topic: Column | None = None) -> DataFrame:
    """The documents drawn, with all their columns."""
    return _drawn(docs, mix or Mix(), topic).where("kept").select("row.*")
