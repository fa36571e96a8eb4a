"""Token ids in a byte-aligned variable-length format with separate control bytes.

All ids of the corpus are counted, and an id is stored as its place by falling count (ties: the smaller id), so
that most take one byte. A block holds the ids of consecutive documents: a control stream of two bits for each
id, its bytes less one, and a data stream of those bytes, low first. Control bytes are decoded by table lookup.

Documents are in ascending order of doc_id over all shards, nulls first; rows of equal doc_id by their ids' CRC.
Blocks are stored as rows of a Parquet table, so that any file system that Spark knows will do and a lost
executor's blocks are written again: shard, block (in order), before (ids before it in its shard), docs and counts,
control, data. Null or empty texts have the end id alone. A very long text has a block of its own. Columns not named
are ignored. An empty table has no blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.tokens import crc32, encoder
from quern.sources.scratch import written

#: Ids in a block; a longer document has a block of its own.
BLOCK_IDS = 1 << 18
#: Bytes of ids in a shard.
SHARD_BYTES = 16 << 20
#: Shards whose first places are broadcast, 12 bytes each; more are joined by a shuffle.
BROADCAST_SHARDS = 1_000_000


def encode_ids(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control and data streams of unsigned 32-bit values."""
    values = values.astype("<u4", copy=False)
    size = 1 + (values > 0xFF) + (values > 0xFFFF) + (values > 0xFFFFFF)
    codes = np.zeros(-(-len(values) // 4) * 4, np.uint8)
    codes[: len(values)] = size - 1
    control = codes.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)
    used = np.arange(4) < size[:, None]
    return control.sum(axis=1, dtype=np.uint8).tobytes(), values.view(np.uint8).reshape(-1, 4)[used].tobytes()


#: Bytes of the four values under each control byte.
LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3).astype(np.int64) + 1
#: Which bits of four loaded bytes belong to a value of each length.
MASKS = np.array([0, 0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], np.uint32)


def decode_ids(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The ``n`` values of two streams."""
    lengths = LENGTHS[np.frombuffer(control, np.uint8)].ravel()[:n]
    starts = np.cumsum(lengths) - lengths
    padded = np.frombuffer(data + b"\0\0\0", np.uint8).astype(np.uint32)
    loaded = padded[starts] | padded[starts + 1] << np.uint32(8) | padded[starts + 2] << np.uint32(16) | padded[starts + 3] << np.uint32(24)
    return loaded & MASKS[lengths]


def token_table(docs: DataFrame, path: str, end_id: int, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns of each row with ids (bytes, 2 or 4 each, by vocabulary), n_tokens and crc; end id appended."""
    source = docs.select(F.struct(*keep).alias("kept"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        end = np.array([end_id], "<u4")
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                ids = [np.concatenate([x, end]) for x in enc.encode(part.column(1).to_pylist())]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array([x.astype(enc.dtype).tobytes() for x in ids], pa.binary()),
                        pa.array([len(x) for x in ids], pa.int64()),
                        pa.array([crc32(x) for x in ids], pa.int64()),
                    ],
                    names=["kept", "ids", "n_tokens", "crc"],
                )

    kept = source.schema["kept"].dataType.simpleString()
    return source.mapInArrow(run, f"kept {kept}, ids binary, n_tokens long, crc long").select("kept.*", "ids", "n_tokens", "crc")


def id_ranks(tokens: DataFrame, size: int, width: int) -> np.ndarray:
    """The place of each id by falling count; at most ``size`` rows reach the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            for x in batch.column(0):
                total += np.bincount(np.frombuffer(x.as_buffer(), f"<u{width}"), minlength=size)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], names=["id", "n"])

    counts = np.zeros(size, np.int64)
    found = tokens.select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    counts[found["id"].to_numpy()] = found["n"].to_numpy()
    ranks = np.empty(size, np.uint32)
    ranks[np.argsort(-counts, kind="stable")] = np.arange(size, dtype=np.uint32)
    return ranks


def write_blocks(tokens: DataFrame, ranks: np.ndarray, width: int) -> DataFrame:
    """Writes doc_id and ids of ``tokens`` as blocks to the shared folder; returns the table of blocks."""
    spark = tokens.sparkSession
    total = tokens.agg(F.sum("n_tokens")).first()[0] or 0
    shards = max(1, -(-total * width // SHARD_BYTES), spark.sparkContext.defaultParallelism)
    place = spark.sparkContext.broadcast(ranks)  # as long as the vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        n = block = before = 0
        for batch in batches:
            for doc, ids in zip(batch.column("doc_id").to_pylist(), batch.column("ids"), strict=True):
                x = np.frombuffer(ids.as_buffer(), f"<u{width}")
                if held and n + len(x) > BLOCK_IDS:
                    yield pack(block, before, held)
                    held, n, block, before = [], 0, block + 1, before + n
                held.append((doc, place.value[x]))
                n += len(x)
        if held:
            yield pack(block, before, held)

    def pack(block: int, before: int, held: list) -> pa.RecordBatch:
        control, data = encode_ids(np.concatenate([x for _, x in held]))
        return pa.RecordBatch.from_pylist(
            [{"block": block, "before": before, "docs": [d for d, _ in held], "counts": [len(x) for _, x in held], "control": control, "data": data}],
            pa.schema([("block", pa.int64()), ("before", pa.int64()), ("docs", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64())), ("control", pa.binary()), ("data", pa.binary())]),
        )

    ordered = tokens.select(F.col("doc_id").cast("long").alias("doc_id"), "ids", "crc").repartitionByRange(shards, "doc_id", "crc").sortWithinPartitions("doc_id", "crc")
    blocks = ordered.mapInArrow(run, "block long, before long, docs array<long>, counts array<long>, control binary, data binary")
    return written(blocks.withColumn("shard", F.spark_partition_id()), "token-blocks")


def read_blocks(blocks: DataFrame, ranks: np.ndarray, dtype: str = "<u4") -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids (bytes) of every document of the blocks."""
    spark = blocks.sparkSession
    n_ids = F.aggregate("counts", F.lit(0).cast("long"), lambda s, x: s + x)
    sizes = blocks.groupBy("shard").agg(F.sum(n_ids).alias("n"))
    n_shards = sizes.count()
    bases = written(sizes.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("base")), "shards")  # a short row for each shard
    bases = F.broadcast(bases) if n_shards <= BROADCAST_SHARDS else bases
    ids = spark.sparkContext.broadcast(np.argsort(ranks).astype("<u4"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                counts = np.array(row["counts"], np.int64)
                found = ids.value[decode_ids(row["control"], row["data"], int(counts.sum()))]
                ends = np.cumsum(counts)
                parts = np.split(found, ends[:-1])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(row["docs"], pa.int64()),
                        pa.array(row["base"] + row["before"] + ends - counts, pa.int64()),
                        pa.array(counts, pa.int64()),
                        pa.array([x.astype(dtype).tobytes() for x in parts], pa.binary()),
                    ],
                    names=["doc_id", "start", "n_tokens", "ids"],
                )

    return blocks.join(bases, "shard").select("base", "before", "docs", "counts", "control", "data").mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")
