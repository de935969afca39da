"""Exact deduplication by content-defined chunk recipes, in DataFrame functions only.

A text without white space is cut where its own characters say so (a pair of characters of two fixed
classes, between a least and a most length). A chunk's identifier is a pair of 64-bit hashes; one pass
moves every distinct chunk once and verifies that no identifier stands for two chunks. A document is
then the ordered list of its identifiers, and only these lists are grouped and compared, so long
documents do not travel. Should an identifier ever fail verification, the lists hold the chunks
themselves, which is exact as well.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import checkpointed

WHITE = r"[\x20\x09-\x0D]+"
LEAST, MOST = 512, 4096


def _class(latin: str, part: int) -> str:
    """A regex class: some Latin characters, and an eighth of the code points of every other script by rule."""
    ranges = [(a, a + 15) for a in range(0x100 + 16 * part, 0x3000, 128)] + [(a, a + 255) for a in range(0x3000 + 256 * part, 0xD800, 2048)]
    return "[" + latin + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in ranges) + "]"


CHUNK = f"(?s).{{{LEAST - 2},{MOST - 2}}}?{_class('acdhlu0-3', 1)}{_class('bgkpvwyz4-6', 4)}|.{{1,{MOST}}}"


def squeezed(text: str = "text") -> Column:
    """The text without white space; null is empty."""
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), WHITE, "")


def _identifiers(chunks: Column) -> Column:
    """The recipe: both hashes of every chunk, in order."""
    return F.concat(F.transform(chunks, lambda c: F.xxhash64(c)), F.transform(chunks, lambda c: F.xxhash64(F.lit(7), c)))


def unverified(docs: DataFrame) -> DataFrame:
    """Identifiers that stand for more than one chunk (no rows, in practice)."""
    chunks = docs.select(F.explode(F.regexp_extract_all(squeezed(), F.lit(CHUNK), F.lit(0))).alias("chunk"))
    distinct = chunks.select(F.xxhash64("chunk").alias("a"), F.xxhash64(F.lit(7), "chunk").alias("b"), "chunk").distinct()
    return distinct.groupBy("a", "b").count().where("count > 1")


def recipes(docs: DataFrame, verified: bool) -> DataFrame:
    """doc_id, n_cp (code points of the text), text_sha256 (of the squeezed text), recipe."""
    narrow = docs.select("doc_id", F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n_cp"), squeezed().alias("squeezed"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("raw_sha256"))
    chunks = F.regexp_extract_all("squeezed", F.lit(CHUNK), F.lit(0))
    return narrow.select("doc_id", "n_cp", F.sha2("squeezed", 256).alias("text_sha256"), "raw_sha256", (_identifiers(chunks) if verified else chunks).alias("recipe"))


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Of texts that are equal without white space, the longest in code points stays, then the smallest
    doc_id. A null text is empty; all empty texts are one group. A null doc_id counts as the largest.
    Repeated rows count in group_size, and each copy of the row that stays is marked kept. Extra
    columns are ignored.
    """
    return _decided(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def _decided(docs: DataFrame) -> DataFrame:
    docs = docs.select("doc_id", "text")
    rows = checkpointed(recipes(docs, verified=unverified(docs).isEmpty()))
    best = F.min(F.struct((-F.col("n_cp")).alias("shorter"), F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("doc_id")))
    groups = rows.groupBy("recipe").agg(best.alias("best"), F.count(F.lit(1)).alias("group_size"))
    # a key that the grouping does not know: both sides are dealt anew, so a hot group's rows can be split
    groups = groups.select(F.xxhash64("recipe").alias("key"), F.col("recipe").alias("group_recipe"), "best", "group_size")
    keyed = rows.withColumn("key", F.xxhash64("recipe"))
    joined = keyed.join(groups, (keyed["key"] == groups["key"]) & (keyed["recipe"] == groups["group_recipe"]))
    kept = keyed["doc_id"].eqNullSafe(F.col("best.doc_id")) & (-F.col("n_cp") == F.col("best.shorter"))
    return joined.select(keyed["doc_id"].alias("doc_id"), F.col("best.doc_id").alias("keep_id"), "group_size", kept.alias("kept"), "text_sha256", "raw_sha256")


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents that stay, with all their columns; rows that repeat as a whole stay once."""
    kept = _decided(docs).where("kept").select(F.col("doc_id").alias("__id"), F.col("raw_sha256").alias("__sha")).distinct()
    rows = docs.select(F.struct("*").alias("__row"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("__raw"))
    joined = rows.join(kept, F.col("__row.doc_id").eqNullSafe(F.col("__id")) & (F.col("__raw") == F.col("__sha")), "left_semi")
    once = joined.select("__row", F.col("__row.doc_id").alias("__id"), "__raw").dropDuplicates(["__id", "__raw"])
    return once.select("__row.*")


SQL = r"""
with base as (
  select doc_id, coalesce(text, '') as t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') as norm from documents
), ranked as (
  select doc_id, norm, length(t) as n_cp,
         first_value(doc_id) over w as keep_id, first_value(length(t)) over w as keep_cp, count(*) over (partition by norm) as group_size
  from base window w as (partition by norm order by length(t) desc, doc_id)
)
select doc_id, keep_id, group_size, (doc_id = keep_id and n_cp = keep_cp) as kept, sha256(norm) as text_sha256 from ranked
"""
