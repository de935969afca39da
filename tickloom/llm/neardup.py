"""Near-duplicate documents by MinHash.

A document is the set of its distinct word shingles. One hash of each shingle is enough: its top part
picks a bin, the least hash in a bin is that bin's sample (one-permutation hashing), and an empty bin
takes over the sample of another that a fixed random sequence of bins finds first (optimal
densification). Bands of samples are buckets; each bucket links its members to one hub, so a bucket of n
gives n - 1 candidate edges. The hub is the most central member, the one whose buckets hold most
documents: in a family of copies that is the text they were made from. Every edge is confirmed on the
full sets of both texts.

Members of a bucket that are in different components after that are compared in blocks of bounded size,
each pair in the first bucket that it shares. A task holds the sets of two blocks, rejects a pair by a
bound that is never below its true overlap, and gives at most one edge for two components, so no pair of
a bucket is told apart unseen and none of the rejected ones is a row. Documents with equal sets stand
for one another from the start.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .text import Words, arrow_map, checkpointed, gram_hashes, mix, only_likely, slices

SHINGLE = 5
BANDS, ROWS = 48, 4
#: Bits of a shingle's hash; the rest of a sort key holds the text's number within a slice.
BITS = 50
MOST_TEXTS = 1 << (64 - BITS)
PERCENT = 75
#: What a block of a bucket holds at most on average: documents, and shingles of them.
BLOCK_DOCS, BLOCK_SHINGLES = 2048, 1 << 20
#: Shared shingles that 32-bit hashes may feign; a pair this far above the bar is a link for certain.
SLACK = 8
#: Node numbers of documents without an id begin here, so they come after all others.
NO_ID = 1 << 62


def shingle_sets(texts: pa.Array, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(bounds, hashes): the sorted distinct shingles of each text. Fewer than n words are one shingle."""
    words = Words(texts, lower=True)
    size, hashes = words.counts, words.hashes()
    keys = []
    grams = gram_hashes(hashes, n)
    if len(grams):
        doc = words.doc_of()
        same = doc[: len(grams)] == doc[n - 1 :]
        keys.append((doc[: len(grams)][same].astype(np.uint64) << np.uint64(BITS)) | (grams[same] >> np.uint64(64 - BITS)))
    short = np.flatnonzero((size > 0) & (size < n))
    for d in short.tolist():
        a, b = words.offsets[d], words.offsets[d + 1]
        keys.append((np.uint64(d) << np.uint64(BITS)) | (gram_hashes(hashes[a:b], int(b - a), seed=int(b - a)) >> np.uint64(64 - BITS)))
    key = _distinct(np.concatenate(keys)) if keys else np.empty(0, np.uint64)
    owner = (key >> np.uint64(BITS)).astype(np.int64)
    bounds = np.searchsorted(owner, np.arange(len(texts) + 1))
    return bounds, key & np.uint64((1 << BITS) - 1)


def _distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    keep = np.empty(len(x), bool)
    keep[:1] = True
    keep[1:] = x[1:] != x[:-1]
    return x[keep]


def _detours(bins: int, tries: int = 24) -> np.ndarray:
    """For every try, the bin that each empty bin looks at: random ones first, then all in a cycle."""
    random = mix(np.arange(tries * bins, dtype=np.uint64) + np.uint64(0x5EED)).reshape(tries, bins) % np.uint64(bins)
    cycle = (np.arange(bins)[None, :] + np.arange(1, bins)[:, None]) % bins
    return np.concatenate([random.astype(np.int64), cycle])


def signatures(bounds: np.ndarray, hashes: np.ndarray, bins: int) -> np.ndarray:
    """Densified one-permutation samples, a row for each set that is not empty (others: zeros)."""
    n = len(bounds) - 1
    owner = np.repeat(np.arange(n), np.diff(bounds))
    place = owner * bins + ((hashes * np.uint64(bins)) >> np.uint64(BITS)).astype(np.int64)
    first = np.empty(len(place), bool)
    first[:1] = True
    first[1:] = place[1:] != place[:-1]
    sample, filled = np.zeros(n * bins, np.uint64), np.zeros(n * bins, bool)
    sample[place[first]] = hashes[first]
    filled[place[first]] = True
    empty = np.flatnonzero(~filled & np.repeat(np.diff(bounds) > 0, bins))
    for detour in _detours(bins):
        if not len(empty):
            break
        source = empty - empty % bins + detour[empty % bins]
        hit = filled[source]
        sample[empty[hit]] = sample[source[hit]]
        empty = empty[~hit]
    return sample.reshape(n, bins)


def band_hashes(samples: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit bucket for each row and band."""
    part = samples.reshape(len(samples), bands, rows)
    out = np.broadcast_to(mix(np.arange(1, bands + 1, dtype=np.uint64)), part.shape[:2]).copy()
    for k in range(rows):
        out = mix(out * np.uint64(0xD6E8FEB86659FD93) + part[:, :, k])
    return out


SKETCH = "node long, tkey long, n_shingles long, set_a long, set_b long, bands array<long>"


def sketches(docs: DataFrame, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """node, tkey, n_shingles, a 128-bit digest of the set, and the buckets (none for an empty set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, MOST_TEXTS):
                for part in slices(batch.slice(start, MOST_TEXTS)):
                    bounds, hashes = shingle_sets(part.column("text"))
                    size = np.diff(bounds)
                    buckets = band_hashes(signatures(bounds, hashes, bands * rows), bands, rows)
                    total = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(hashes + np.uint64(salt)))]) for salt in (1, 2)]
                    digest = [pa.array((t[bounds[1:]] - t[bounds[:-1]]).view(np.int64)) for t in total]
                    full = size > 0
                    offsets = np.concatenate([[0], np.cumsum(full * bands)]).astype(np.int32)
                    column = pa.ListArray.from_arrays(pa.array(offsets), pa.array(buckets[full].ravel().view(np.int64)))
                    yield pa.RecordBatch.from_arrays([part.column("node"), part.column("tkey"), pa.array(size.astype(np.int64)), *digest, column], names=["node", "tkey", "n_shingles", "set_a", "set_b", "bands"])

    return arrow_map(docs.select("node", "tkey", "text"), run, SKETCH)


def _texts_of(nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """(node, text) of the documents, without most of those whose node is not asked for."""
    none = F.lit(0).cast("long").alias("tkey")
    return only_likely(docs.select(F.col("node").alias("row"), none, "text"), nodes.select(F.col("node").alias("row"), none)).select(F.col("row").alias("node"), "text")


def confirmed(pairs: DataFrame, docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Of the pairs (a, b) of nodes, those whose full sets meet 100 * intersection >= percent * union."""
    texts = _texts_of(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), docs)
    left = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
    full = left.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text_a"):
                for piece in slices(part, "text_b"):
                    hubs, first = np.unique(np.asarray(piece.column("b")), return_index=True)
                    of_hub = np.searchsorted(hubs, np.asarray(piece.column("b")))
                    hub_bounds, hub_sets = shingle_sets(piece.column("text_b").take(pa.array(first)))
                    bounds, sets = shingle_sets(piece.column("text_a"))
                    ok = np.zeros(piece.num_rows, bool)
                    for k in range(piece.num_rows):
                        x = sets[bounds[k] : bounds[k + 1]]
                        y = hub_sets[hub_bounds[of_hub[k]] : hub_bounds[of_hub[k] + 1]]
                        if not len(x) or not len(y) or 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
                            continue
                        at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                        both = int((y[at] == x).sum())
                        ok[k] = 100 * both >= percent * (len(x) + len(y) - both)
                    yield pa.RecordBatch.from_arrays([piece.column("a").filter(pa.array(ok)), piece.column("b").filter(pa.array(ok))], names=["a", "b"])

    return arrow_map(full.select("a", "b", "text_a", "text_b"), run, "a long, b long")


def _stars(buckets: DataFrame) -> DataFrame:
    """(band, bucket, member, hub) for the members of shared buckets but their hubs; buckets: (band, bucket, member)."""
    # dealt by a key that the grouping does not know, so the rows of a hot bucket can be split
    key = F.xxhash64("bucket").alias("key")
    sizes = buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1").select(key, F.col("bucket").alias("own"), "size")
    dealt = buckets.withColumn("key", F.xxhash64("bucket"))
    shared = checkpointed(dealt.join(sizes, (dealt["key"] == sizes["key"]) & (dealt["bucket"] == sizes["own"])).select("band", "bucket", "member", "size"))
    central = shared.groupBy("member").agg(F.sum("size").alias("central"))
    best = F.min(F.struct((-F.col("central")).alias("less"), "member")).alias("h")
    hubs = shared.join(central, "member").groupBy("bucket").agg(best).select(key, F.col("bucket").alias("own"), F.col("h.member").alias("hub"))
    dealt = shared.withColumn("key", F.xxhash64("bucket"))
    stars = dealt.join(hubs, (dealt["key"] == hubs["key"]) & (dealt["bucket"] == hubs["own"])).where("member <> hub")
    return checkpointed(stars.select("band", "bucket", "member", "hub"))


def _left_over(stars: DataFrame, labels: DataFrame) -> DataFrame:
    """(band, bucket, member, label, outside) of the buckets whose members, hubs apart, are in several components.

    outside: in another component than the hub.
    """
    of = lambda name: labels.select(F.col("id").alias(f"{name}_id"), F.col("label").alias(f"{name}_label"))
    told = stars.join(of("member"), F.col("member") == F.col("member_id"), "left").join(of("hub"), F.col("hub") == F.col("hub_id"), "left")
    label, home = F.coalesce("member_label", "member"), F.coalesce("hub_label", "hub")
    told = checkpointed(told.select("band", "bucket", "member", label.alias("label"), (label != home).alias("outside")))
    mixed = told.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high")
    mixed = mixed.select(F.xxhash64("bucket").alias("key"), F.col("bucket").alias("own"))
    dealt = told.withColumn("key", F.xxhash64("bucket"))
    return checkpointed(dealt.join(mixed, (dealt["key"] == mixed["key"]) & (dealt["bucket"] == mixed["own"])).select("band", "bucket", "member", "label", "outside"))


CELL = "band int, bucket long, i int, j int, block int, member long, label long, size long, hashes array<int>, bands array<int>"


def _cells(left: DataFrame, docs: DataFrame, bands: int, rows: int) -> DataFrame:
    """The members with their sets, in every cell (bucket, i, j) of two blocks that they are part of.

    A bucket's outside members make up its first blocks, the others the blocks after them; i is a block
    of the first kind and j any from i on, so pairs inside the hub's component have no cell.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, MOST_TEXTS):
                for part in slices(batch.slice(start, MOST_TEXTS)):
                    bounds, hashes = shingle_sets(part.column("text"))
                    buckets = (band_hashes(signatures(bounds, hashes, bands * rows), bands, rows) >> np.uint64(32)).astype(np.uint32)
                    sets = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array((hashes >> np.uint64(BITS - 32)).astype(np.uint32).view(np.int32)))
                    ends = np.arange(len(bounds), dtype=np.int32) * bands
                    yield pa.RecordBatch.from_arrays([part.column("node"), pa.array(np.diff(bounds).astype(np.int64)), sets, pa.ListArray.from_arrays(pa.array(ends), pa.array(buckets.ravel().view(np.int32)))], names=["node", "size", "hashes", "bands"])

    members = left.select(F.col("member").alias("node")).distinct()
    texts = _texts_of(members, docs).join(members, "node", "left_semi")
    sets = checkpointed(arrow_map(texts, run, "node long, size long, hashes array<int>, bands array<int>"))
    sized = left.join(sets.select("node", "size"), F.col("member") == F.col("node")).select("bucket", "outside", "size")
    blocks = lambda which: F.greatest(F.ceil(F.count_if(which) / BLOCK_DOCS), F.ceil(F.sum(F.when(which, F.col("size")).otherwise(0)) / BLOCK_SHINGLES)).cast("int")
    grid = sized.groupBy("bucket").agg(blocks(F.col("outside")).alias("n_out"), blocks(~F.col("outside")).alias("n_in")).select(F.xxhash64("bucket").alias("key"), F.col("bucket").alias("own"), "n_out", "n_in")
    dealt = left.withColumn("key", F.xxhash64("bucket"))
    placed = dealt.join(grid, (dealt["key"] == grid["key"]) & (dealt["bucket"] == grid["own"]))
    block = F.when(F.col("outside"), F.pmod(F.xxhash64("member"), "n_out")).otherwise(F.col("n_out") + F.pmod(F.xxhash64("member"), "n_in")).cast("int")
    placed = placed.withColumn("block", block)
    before = F.transform(F.sequence(F.lit(0), F.least(F.col("block"), F.col("n_out") - 1)), lambda i: F.struct(i.alias("i"), F.col("block").alias("j")))
    after = F.transform(F.sequence(F.col("block"), F.col("n_out") + F.col("n_in") - 1), lambda j: F.struct(F.col("block").alias("i"), j.alias("j")))
    cells = F.when(F.col("outside"), F.array_distinct(F.concat(before, after))).otherwise(before)
    spread = placed.select("band", "bucket", "member", "label", "block", F.explode(cells).alias("c"))
    return spread.join(sets, spread["member"] == sets["node"]).select("band", "bucket", "c.i", "c.j", "block", "member", "label", "size", "hashes", "bands")


def _links_in(cell: list[tuple], percent: int) -> list[tuple[int, int]]:
    """Pairs of members in different components whose sets may meet the share, at most one for any two components that surely meet it.

    cell: rows as ``CELL`` names them, of one bucket and two blocks.
    """
    band, _, i, j = cell[0][:4]
    first, second = ([r for r in cell if r[4] == k] for k in (i, j))
    second_bands = np.array([r[9] for r in second])
    size, label = np.array([r[7] for r in second]), np.array([r[6] for r in second])
    up: dict[int, int] = {}

    def top(x: int) -> int:
        while up.get(x, x) != x:
            x = up[x] = up.get(up[x], up[x])
        return x

    out = []
    for at, x in enumerate(first):
        ok = (label != x[6]) & (percent * np.maximum(size, x[7]) <= 100 * np.minimum(size, x[7]))
        if i == j:
            ok[: at + 1] = False
        some = np.flatnonzero(ok)
        if not len(some):
            continue
        shared = second_bands[some] == x[9]
        for y in some[shared.argmax(axis=1) == band].tolist():
            other = second[y]
            if top(x[6]) == top(other[6]):
                continue
            place = np.minimum(np.searchsorted(x[8], other[8]), x[7] - 1)
            spare = (100 + percent) * int((x[8][place] == other[8]).sum()) - percent * (x[7] + other[7])
            if spare >= 0:
                out.append((x[5], other[5]))
                if spare >= SLACK * (100 + percent):
                    up[top(x[6])] = top(other[6])
    return out


def _links_left(cells: DataFrame, percent: int) -> DataFrame:
    """(a, b) of ``_links_in`` over cells that come together within a partition."""

    def told(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            plain = [batch.column(c).to_pylist() for c in ("band", "bucket", "i", "j", "block", "member", "label", "size")]
            hashes, bands = ([np.asarray(x.values).view(np.uint32) for x in batch.column(c)] for c in ("hashes", "bands"))
            for row in zip(*plain, hashes, bands, strict=True):
                if held and held[0][1:4] != row[1:4]:
                    yield told(_links_in(held, percent))
                    held = []
                held.append(row)
        if held:
            yield told(_links_in(held, percent))

    return arrow_map(cells, run, "a long, b long")


def _numbered(docs: DataFrame) -> DataFrame:
    """(doc_id, node, tkey, text): the node is the id; a text without an id gets one of its own after all ids."""
    tkey = F.xxhash64("text")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID) + F.shiftrightunsigned(tkey, 2)).alias("node"), tkey.alias("tkey"), "text")


def _components(docs: DataFrame, bands: int, rows: int, percent: int) -> DataFrame:
    """(node, tkey, n_shingles, component) for each row of ``_numbered`` documents."""
    sketch = checkpointed(sketches(docs, bands, rows))
    same = ["set_a", "set_b", "n_shingles"]
    classes = sketch.where("n_shingles > 0").groupBy(*same).agg(F.min("node").alias("rep"))
    # dealt by a key that the grouping does not know, so the rows of a hot class can be split
    keyed = classes.select(F.xxhash64(*same).alias("key"), *[F.col(c).alias(f"class_{c}") for c in same], "rep")
    mine = sketch.withColumn("key", F.xxhash64(*same))
    found = mine.join(keyed, (mine["key"] == keyed["key"]) & (mine["set_a"] == keyed["class_set_a"]) & (mine["set_b"] == keyed["class_set_b"]) & (mine["n_shingles"] == keyed["class_n_shingles"]), "left")
    members = checkpointed(found.select("node", "tkey", "n_shingles", "rep", F.when(F.col("node") == F.col("rep"), F.col("bands")).alias("bands")))
    stars = _stars(members.where("bands is not null").select(F.col("node").alias("member"), F.posexplode("bands").alias("band", "bucket")))
    pairs = checkpointed(stars.select(F.col("member").alias("a"), F.col("hub").alias("b")).distinct())
    links = checkpointed(confirmed(pairs, docs, percent))
    labels = components(links)
    left = _left_over(stars, labels)
    cells = _cells(left, docs, bands, rows).repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    more = checkpointed(_links_left(cells, percent).distinct())
    if not more.isEmpty():
        labels = components(links.union(confirmed(more, docs, percent)))
    out = members.join(labels, members["rep"] == labels["id"], "left")
    return out.select("node", "tkey", "n_shingles", F.coalesce("label", "rep", "node").alias("component"))


def near_duplicates(docs: DataFrame, bands: int = BANDS, rows: int = ROWS, percent: int = PERCENT) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    A text that is null or has no words has an empty set and is linked with nothing. component_id is
    the smallest doc_id that links reach; a row is kept if it is its own. A document with a null doc_id
    is linked as any other, after all that have one; where no document of a component has an id,
    component_id is null and the text with the smallest hash is kept. Rows that repeat a doc_id count as
    one document and get a row each. Texts of any length are taken whole, one at a time if they are
    large. An empty table gives no rows. Extra columns are ignored.
    """
    told = _components(_numbered(docs), bands, rows, percent)
    real = lambda c: F.when(F.col(c) < NO_ID, F.col(c))
    return told.select(real("node").alias("doc_id"), "n_shingles", real("component").alias("component_id"), (F.col("node") == F.col("component")).alias("kept"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents that stay, with all their columns: one of each component.

    A row is told by its id and text, so rows that share an id or have none are each judged by their own
    text; rows that repeat both are one document.
    """
    own = _numbered(docs)
    kept = _components(own, BANDS, ROWS, PERCENT).where("node = component").select("node", "tkey").distinct()
    rows = docs.select(F.struct("*").alias("__row"), F.col("doc_id").cast("long").alias("__id"), F.xxhash64("text").alias("__tkey"))
    rows = rows.withColumn("__node", F.coalesce("__id", F.lit(NO_ID) + F.shiftrightunsigned("__tkey", 2)))
    return rows.join(kept, (F.col("__node") == F.col("node")) & (F.col("__tkey") == F.col("tkey")), "left_semi").select("__row.*")


SQL = r"""
with recursive words as (
  select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents
), shingles as (
  select distinct doc_id, array_to_string(w[i:i + 4], ' ') as s
  from (select doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) as i from words where len(w) > 0)
), sizes as (
  select doc_id, count(*) as n from shingles group by doc_id
), common as (
  select a.doc_id as a, b.doc_id as b, count(*) as shared from shingles a join shingles b on a.s = b.s and a.doc_id < b.doc_id group by 1, 2
), links as (
  select a, b from common join sizes x on x.doc_id = a join sizes y on y.doc_id = b where 100 * shared >= 75 * (x.n + y.n - shared)
), steps as (
  select a, b from links union select b, a from links
), reach(doc, c) as (
  select a, a from steps union select s.b, r.c from reach r join steps s on s.a = r.doc
), labels as (
  select doc, min(c) as c from reach group by doc
)
select d.doc_id, coalesce(n, 0) as n_shingles, coalesce(c, d.doc_id) as component_id, coalesce(c, d.doc_id) = d.doc_id as kept
from documents d left join sizes on sizes.doc_id = d.doc_id left join labels on labels.doc = d.doc_id
"""
