"""Token-id output: frequency-ranked ids in byte-aligned variable-length coding.

File format (a folder, written and read by Spark, so any store will do):

* ``vocab`` (rank, token_id, n): the ids of the corpus by falling frequency.
* ``blocks`` (shard, block, before, doc_ids, lengths, n_tokens, control, data):
  whole documents in ascending order of (shard, block). An id is stored as its
  rank in 1 to 4 little-endian bytes in ``data``; ``control`` holds, apart from
  the data, 2 bits for each id: its number of bytes less one, four ids a byte,
  the first in the lowest bits. ``before`` counts the shard's ids before the block.

Decoding looks the control bytes up in a table of 256 rows of four lengths; sums
of lengths give each id's place, and a masked 4-byte read its rank.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tillsight.llm.bpe_cache import encoder
from tillsight.llm.common import scratch_path, small, text_of, written

#: Ids of a block, about; a longer document is a block of its own.
BLOCK_IDS = 65_536
#: Fixed value of the contract: the id that ends each document.
END_ID = 2

#: Control byte -> the lengths of its four ids.
LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3).astype(np.uint8) + 1
_MASK = np.array([0, 0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], dtype=np.uint32)


def pack(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """(control, data) of unsigned 32-bit numbers."""
    ranks = np.ascontiguousarray(ranks, dtype="<u4")
    top = int(ranks.max(initial=0))
    width = 1 + (top > 0xFF) + (top > 0xFFFF) + (top > 0xFFFFFF)
    padded = np.zeros(-(-len(ranks) // 4) * 4, dtype=np.uint8)
    code = padded[:len(ranks)]
    kept = np.ones((len(ranks), width), dtype=bool)
    for more in range(1, width):  # a number has its next byte if it is above what the bytes before hold
        kept[:, more] = ranks > _MASK[more]
        code += kept[:, more]
    four = padded.view("<u4")
    control = four | four >> 6 | four >> 12 | four >> 18
    octets = ranks.view(np.uint8).reshape(-1, 4)[:, :width]
    return control.astype(np.uint8).tobytes(), np.ascontiguousarray(octets).ravel()[kept.ravel()].tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The ``n`` numbers that ``pack`` wrote."""
    if not n:
        return np.zeros(0, dtype=np.uint32)
    lengths = LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    ends = np.cumsum(lengths, dtype=np.int64)
    four = np.ndarray(shape=len(data), dtype="<u4", buffer=data + b"\0\0\0\0", strides=(1,))
    return four[ends - lengths] & _MASK[lengths]


_RAW = "shard int, block int, before long, doc_ids array<long>, lengths array<int>, n_tokens long, ids binary"
_BLOCKS = _RAW.replace("ids binary", "control binary, data binary")
#: A task's last block also has its counts of ids.
_COUNTS = "token_id array<int>, n array<long>"


def _tokenised(docs: DataFrame, tokenizer: str, end_id: int, block_ids: int) -> DataFrame:
    """Documents in ascending doc_id order -> blocks of plain ids, counted."""
    item = encoder(tokenizer).dtype.itemsize
    schema = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("before", pa.int64()),
                        ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int32())),
                        ("n_tokens", pa.int64()), ("ids", pa.binary()),
                        ("token_id", pa.list_(pa.int32())), ("n", pa.list_(pa.int64()))])

    def blocks(batches):
        enc = encoder(tokenizer)
        end = np.array([end_id], dtype=enc.dtype).tobytes()
        shard, block, before = TaskContext.get().partitionId(), 0, 0
        doc_ids, lengths, ids, n = [], [], [], 0
        total, last = np.zeros(1, dtype=np.int64), None

        def close():
            nonlocal block, before, doc_ids, lengths, ids, n, total, last
            out, joined = last, b"".join(ids)
            last = {"shard": shard, "block": block, "before": before, "doc_ids": doc_ids, "lengths": lengths,
                    "n_tokens": n, "ids": joined}
            found = np.bincount(np.frombuffer(joined, enc.dtype), minlength=len(total))
            found[:len(total)] += total
            total = found
            block, before, doc_ids, lengths, ids, n = block + 1, before + n, [], [], [], 0
            if out:
                yield pa.RecordBatch.from_pylist([out], schema=schema)

        for batch in batches:
            for doc_id, coded in zip(batch.column(0).to_pylist(), enc.encode_batch(batch.column(1))):
                coded += end
                doc_ids.append(doc_id)
                lengths.append(len(coded) // item)
                ids.append(coded)
                n += lengths[-1]
                if n >= block_ids:
                    yield from close()
        if doc_ids:
            yield from close()
        if last:
            used = np.flatnonzero(total)
            yield pa.RecordBatch.from_pylist([last | {"token_id": used.tolist(), "n": total[used].tolist()}], schema=schema)

    text = text_of()
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"),
                        F.xxhash64(text).alias("h"), F.monotonically_increasing_id().alias("seq"))
    order = ["doc_id", "h", "seq"]  # repeated ids do not have to share a partition
    return (keyed.repartitionByRange(*order).sortWithinPartitions(*order)
                 .select("doc_id", "text").mapInArrow(blocks, f"{_RAW}, {_COUNTS}"))


def write_corpus(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID,
                 block_ids: int = BLOCK_IDS) -> None:
    """Encode every whole text and write the folder ``path`` (see the module).

    Defined results: a null text counts as empty (it has the end id alone);
    documents are in ascending doc_id order, null first, equal ids by a hash of
    their text; an empty table gives a folder without blocks.
    """
    spark = docs.sparkSession
    raw = written(_tokenised(docs, tokenizer, end_id, block_ids), "ids")
    dtype = encoder(tokenizer).dtype

    counts = (raw.where("n is not null").select(F.inline(F.arrays_zip("token_id", "n")))
                 .groupBy("token_id").agg(F.sum("n").alias("n")))
    ranked = counts.orderBy(F.desc("n"), "token_id").collect()  # a row per vocabulary entry at most
    rows = [(rank, r["token_id"], r["n"]) for rank, r in enumerate(ranked)]
    spark.createDataFrame(rows, "rank int, token_id int, n long").coalesce(1).write.parquet(f"{path}/vocab")
    rank_of = np.zeros(max((r[1] for r in rows), default=0) + 1, dtype=np.uint32)
    rank_of[[r[1] for r in rows]] = [r[0] for r in rows]

    def coded(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                control, data = pack(rank_of[np.frombuffer(row.column(6)[0].as_py(), dtype)])
                yield pa.RecordBatch.from_arrays(
                    [*row.columns[:6], pa.array([control], pa.binary()), pa.array([data], pa.binary())],
                    names=[*row.schema.names[:6], "control", "data"])

    raw.drop("token_id", "n").mapInArrow(coded, _BLOCKS).write.option("compression", "zstd").parquet(f"{path}/blocks")


def read_corpus(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (and ``ids``) of every document in the folder."""
    vocab = spark.read.parquet(f"{path}/vocab").orderBy("rank").collect()
    id_of = np.array([r["token_id"] for r in vocab] or [0], dtype="<u4")
    blocks = spark.read.parquet(f"{path}/blocks")
    per_shard = blocks.groupBy("shard").agg(F.sum("n_tokens").alias("n"))  # a row per shard
    earlier = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = written(per_shard.select("shard", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("start")), "starts")
    placed = blocks.join(small(starts, 1_000_000), "shard").select(
        (F.col("start") + F.col("before")).alias("start"), "doc_ids", "lengths", "control", "data")

    def decoded(batches):
        for batch in batches:
            for start, doc_ids, lengths, control, data in zip(*batch.columns):
                lengths = np.array(lengths.as_py(), dtype=np.int64)
                ends = np.cumsum(lengths)
                ids = id_of[unpack(control.as_py(), data.as_py(), int(lengths.sum()))]
                view = memoryview(ids).cast("B")
                crc = [zlib.crc32(view[4 * a:4 * b]) for a, b in zip(ends - lengths, ends)]
                out = [doc_ids.values, pa.array(start.as_py() + ends - lengths), pa.array(lengths), pa.array(crc, pa.int64())]
                if with_ids:
                    out.append(pa.ListArray.from_arrays(np.append(0, ends), ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays(out, names=names)

    names = ["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids
    return placed.mapInArrow(decoded, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids)


def token_report(docs: DataFrame, tokenizer: str, path: str | None = None) -> DataFrame:
    """Write the corpus (to a scratch folder if no path is given) and digest what is read back."""
    path = path or scratch_path(docs.sparkSession, "tokens")
    write_corpus(docs, path, tokenizer)
    return read_corpus(docs.sparkSession, path, with_ids=False)
