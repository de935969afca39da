"""Exchange order-flow files: framing, decoding, rejects, writing, and the Parquet store.

A file is frames of a two-byte big-endian length and a message. Files are split by file (frames carry
no sync mark), read as binary, and decoded in Arrow batches; sequence numbers are positions in a day.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.session import ensure_importable

#: The protocol's message lengths by type.
LENGTHS = {
    "S": 12, "R": 39, "H": 25, "Y": 20, "L": 26, "V": 35, "W": 12, "K": 28, "J": 35, "h": 21, "A": 36, "F": 40, "E": 31,
    "C": 36, "X": 23, "D": 19, "U": 35, "P": 44, "Q": 40, "B": 19, "I": 50, "N": 20, "O": 48,
}
#: What follows the 11-byte header, as (field, format); "s8" and the like are padded text.
BODIES = {
    "A": "ref:Q side:c shares:I stock:8s price:I", "F": "ref:Q side:c shares:I stock:8s price:I mpid:4s", "E": "ref:Q shares:I match_id:Q",
    "C": "ref:Q shares:I match_id:Q printable:c price:I", "X": "ref:Q shares:I", "D": "ref:Q", "U": "ref:Q new_ref:Q shares:I price:I",
    "P": "ref:Q side:c shares:I stock:8s price:I match_id:Q", "Q": "shares:Q stock:8s price:I match_id:Q cross_type:c",
    "R": "stock:8s category:c financial:c round_lot:I lots_only:c classification:c subtype:2s authenticity:c short_sale:c ipo:c tier:c fund:c leverage:I inverse:c",
    "H": "stock:8s state:c reserved:c reason:4s", "B": "match_id:Q", "S": "event:c",
    "I": "paired:Q imbalance:Q direction:c stock:8s far:I near:I price:I cross_type:c variation:c",
}
READERS = {k: ([f.split(":")[0] for f in b.split()], struct.Struct(">" + "".join(f.split(":")[1] for f in b.split()))) for k, b in BODIES.items()}
HEADER = struct.Struct(">cHH6s")

FIELDS = [
    ("seq", pa.int64()), ("ts_ns", pa.int64()), ("locate", pa.int32()), ("msg_type", pa.string()), ("status", pa.string()), ("ref", pa.int64()), ("new_ref", pa.int64()), ("side", pa.string()),
    ("shares", pa.int64()), ("price", pa.int64()), ("match_id", pa.int64()), ("printable", pa.string()), ("stock", pa.string()), ("mpid", pa.string()), ("cross_type", pa.string()), ("state", pa.string()),
    ("imbalance", pa.int64()), ("paired", pa.int64()), ("direction", pa.string()),
    ("category", pa.string()), ("round_lot", pa.int64()),
]
SCHEMA = ", ".join(f"{n} {'string' if t == pa.string() else 'int' if t == pa.int32() else 'long'}" for n, t in FIELDS)


def frames(data: bytes) -> Iterator[bytes]:
    """Whole messages of a buffer; a cut-off end is left out (see trailing)."""
    at = 0
    while at + 2 <= len(data):
        n = int.from_bytes(data[at : at + 2], "big")
        if at + 2 + n > len(data):
            return
        yield data[at + 2 : at + 2 + n]
        at += 2 + n


def trailing(data: bytes, messages: int, size: int) -> int:
    """Bytes behind the last whole frame of a buffer that gave so many messages of so many bytes."""
    return len(data) - size - 2 * messages


def decode(message: bytes) -> dict:
    """A message's fields, with status ok, header_only, truncated, bad_length or unknown_type; only ok ones have a body."""
    if not message:
        return {"status": "truncated"}
    kind = message[:1].decode("latin-1")
    if kind not in LENGTHS:
        return {"msg_type": kind, "status": "unknown_type"}
    if len(message) != LENGTHS[kind]:
        return {"msg_type": kind, "status": "truncated" if len(message) < LENGTHS[kind] else "bad_length"}
    _, locate, _, ts = HEADER.unpack_from(message)
    out = {"msg_type": kind, "locate": locate, "ts_ns": int.from_bytes(ts, "big"), "status": "ok"}
    if kind not in READERS:
        return out | {"status": "header_only"}
    names, reader = READERS[kind]
    for name, v in zip(names, reader.unpack_from(message, HEADER.size), strict=True):
        out[name] = (v.rstrip(b"\0").decode("latin-1").rstrip() or None) if isinstance(v, bytes) else v
    return out


def encode(m: dict) -> bytes:
    """The frame of a message (inverse of decode, with its length in front)."""
    names, writer = READERS[m["msg_type"]]
    values = []
    for name, fmt in zip(names, (f.split(":")[1] for f in BODIES[m["msg_type"]].split()), strict=True):
        v = m.get(name)
        text = fmt.endswith(("s", "c"))
        values.append((v or "").encode("latin-1").ljust(int(fmt[:-1] or 1) if fmt != "c" else 1) if text else int(v or 0))
    body = HEADER.pack(m["msg_type"].encode(), m.get("locate") or 0, 0, int(m["ts_ns"]).to_bytes(6, "big")) + writer.pack(*values)
    return len(body).to_bytes(2, "big") + body


def read_days(spark: SparkSession, path: str) -> DataFrame:
    """Every message of the files at a path (gzip by name): path, sha256 of the stored bytes, and SCHEMA's columns.

    A cut-off end is a last row of status "trailing", with its bytes in ``shares``.
    """
    ensure_importable(spark)
    raw = spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"), "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import gzip

        for batch in batches:
            for where, digest, content in zip(*(batch.column(c).to_pylist() for c in ("path", "sha256", "content")), strict=True):
                data, rows, seq, size = gzip.decompress(content) if where.endswith(".gz") else content, [], 0, 0
                for m in frames(data):
                    rows.append(decode(m) | {"seq": seq})
                    seq += 1
                    size += len(m)
                    if len(rows) == 20_000:
                        yield told(where, digest, rows)
                        rows = []
                if left := trailing(data, seq, size):
                    rows.append({"seq": seq, "status": "trailing", "shares": left})
                if rows:
                    yield told(where, digest, rows)

    def told(where: str, digest: str, rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([where] * len(rows)), pa.array([digest] * len(rows)), *(pa.array([r.get(n) for r in rows], t) for n, t in FIELDS)], names=["path", "sha256", *(n for n, _ in FIELDS)])

    return raw.mapInArrow(run, f"path string, sha256 string, {SCHEMA}")


def split_rejects(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Good messages, and the others with their status; a cut-off end is in neither (see file_counts)."""
    return messages.where("status in ('ok', 'header_only')"), messages.where("status not in ('ok', 'header_only', 'trailing')").select("path", "seq", "msg_type", "status")


def file_counts(messages: DataFrame) -> DataFrame:
    """Per file: whole frames, those that are no good message, and bytes of a cut-off end."""
    cut = F.col("status") == "trailing"
    return messages.groupBy("path").agg(F.count(F.when(~cut, 1)).alias("frames"), F.count(F.when(~F.col("status").isin("ok", "header_only", "trailing"), 1)).alias("bad"), F.coalesce(F.max(F.when(cut, F.col("shares"))), F.lit(0)).alias("trailing"))


def ingest(messages: DataFrame, store: str, day: str, codec: str = "zstd") -> None:
    """Append a day to the store: Parquet by day, sorted by symbol and sequence so that scans of one symbol prune."""
    good, _ = split_rejects(messages)
    symbols = good.where("stock is not null").groupBy("locate").agg(F.min_by("stock", F.struct(F.when(F.col("msg_type") == "R", 0).otherwise(1), "seq")).alias("symbol"))  # the directory's name, else the first
    table = good.join(symbols, "locate", "left").withColumn("day", F.lit(day))
    table.repartitionByRange("locate", "seq").sortWithinPartitions("locate", "seq").write.mode("append").option("compression", codec).partitionBy("day").parquet(store)


def symbol_scan(spark: SparkSession, store: str, day: str, symbol: str, from_ns: int = 0) -> DataFrame:
    """One symbol's messages of a day from a time on; day, symbol and time are pushed to the scan."""
    return spark.read.parquet(store).where((F.col("day") == day) & (F.col("symbol") == symbol) & (F.col("ts_ns") >= from_ns))


def feed_order(table: DataFrame) -> DataFrame:
    return table.orderBy("seq")


def transcode(spark: SparkSession, store: str, out: str, codec: str) -> None:
    spark.read.parquet(store).write.option("compression", codec).partitionBy("day").parquet(out)


def as_frames(messages: DataFrame) -> DataFrame:
    """Each message's frame again: seq, frame. In order of seq these are the feed's bytes.

    Locate codes are of two bytes, so more symbols take more feeds: messages may have a column ``feed``
    (long), which is kept beside the frames.
    """
    ensure_importable(messages.sparkSession)
    names = [n for n, _ in FIELDS if n in messages.columns]
    beside = ["seq"] + ["feed"] * ("feed" in messages.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in beside), pa.array([encode(r) for r in rows], pa.binary())], names=[*beside, "frame"])

    return messages.where(F.col("msg_type").isin(*READERS)).select(*names, *beside[1:]).mapInArrow(run, ", ".join(f"{c} long" for c in beside) + ", frame binary")
