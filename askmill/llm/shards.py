"""Token ids in files: frequency ranks in byte-aligned variable length, control bytes apart, decoded by table look-up.

A file is Parquet, so that any store and a lost executor's retry are Spark's business; each row is a block:

    shard int, block int      place in ascending key order
    keys                      the documents' keys, in order
    lengths array<int>        ids of each document
    control binary            2 bits for each id, four ids to a byte, the first in the low bits: bytes less one
    data binary               the ranks, little-endian, in 1 to 4 bytes each

An id's rank is its place by how often it occurs in all documents (ties: the smaller id first), so the 256 most
frequent take one byte. The ranks are a file of their own beside the blocks.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from askmill.llm.common import cut, shared_dir
from askmill.llm.tokens import crc, id_encoder, load
from askmill.llm.words import binaries

#: Ids after which a block is closed, and documents.
BLOCK_IDS, BLOCK_DOCS = 400_000, 2_000
#: Ids of a shard, on average, of a large input; and of a small one, which is dealt over the cluster's cores.
SHARD_IDS, LEAST_IDS = 128_000_000, 2_000_000

# What a control byte says: the widths of its four ids, and where each starts.
_WIDTHS = ((np.arange(256)[:, None] >> np.arange(0, 8, 2)[None, :] & 3) + 1).astype(np.uint8)
_TOTAL = _WIDTHS.sum(axis=1)
_PLACE = np.cumsum(_WIDTHS, axis=1) - _WIDTHS
_MASK = np.array([0, 0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], np.uint32)


def pack_ranks(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """uint32 ranks -> control bytes, data bytes."""
    ranks = np.ascontiguousarray(ranks, "<u4")
    width = 1 + (ranks > 0xFF) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    codes = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    codes[: len(ranks)] = width - 1
    control = (codes.reshape(-1, 4) << np.arange(0, 8, 2, dtype=np.uint8)).sum(axis=1).astype(np.uint8)
    most = 2 if width.max(initial=1) <= 2 else 4  # two columns of bytes are enough for nearly all vocabularies
    data = ranks.astype(f"<u{most}").view(np.uint8).reshape(-1, most)[np.arange(most)[None, :] < width[:, None]]
    return control.tobytes(), data.tobytes()


def unpack_ranks(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The inverse: the table gives each control byte's widths and places; one gather reads all ids."""
    c = np.frombuffer(control, np.uint8)
    starts = np.cumsum(_TOTAL[c]) - _TOTAL[c]
    at = (starts[:, None] + _PLACE[c]).ravel()[:n]
    width = _WIDTHS[c].ravel()[:n]
    # Four bytes from each start, wherever it lies; what isn't the id's own is masked away.
    four = np.ndarray((len(data) + 1,), "<u4", data + b"\0\0\0\0", strides=(1,))
    return four[at] & _MASK[width]


def encode_all(docs: DataFrame, path: str, end_id: int, width: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """k, ids: each document's ids with the end id, ``width`` bytes each; counts: in a row behind those of a task, how often each id occurs in them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = id_encoder(path)
        total, kind = np.zeros(0, np.int64), pa.int64()
        names = ["k", "ids", "counts"]
        for batch in batches:
            at, kind = 0, batch.schema.field(0).type
            for part, flat, sizes in encode(batch.column(1), end_id):
                n = np.bincount(flat, minlength=len(total))
                n[: len(total)] += total
                total = n
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(part)), binaries(flat.astype(f"<u{width}"), sizes), pa.nulls(len(part), pa.binary())], names=names)
                at += len(part)
        if len(total):
            yield pa.RecordBatch.from_arrays([pa.nulls(1, kind), pa.nulls(1, pa.binary()), pa.array([total.astype("<i8").tobytes()], pa.binary())], names=names)

    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t"))
    return rows.mapInArrow(run, f"k {rows.schema['k'].dataType.simpleString()}, ids binary, counts binary")


def id_counts(encoded: DataFrame) -> DataFrame:
    """id, n: how often each id occurs in all documents. A task sends a row for each id that its rows of counts have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            for x in batch.column(0):
                own = np.frombuffer(x.as_py(), "<i8")
                n = np.zeros(max(len(own), len(total)), np.int64)
                n[: len(own)] += own
                n[: len(total)] += total
                total = n
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], names=["id", "n"])

    return encoded.filter("counts is not null").select("counts").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def shard_count(ids: int, cores: int) -> int:
    """How many shards so many ids make: as many as they fill; fewer ids than that are spread over twice the cores."""
    return max(1, -(-ids // SHARD_IDS), min(2 * cores, -(-ids // LEAST_IDS)))


def write_shards(docs: DataFrame, path: str, end_id: int, out: str, key: str = "doc_id", text: str = "text", shards: int | None = None) -> str:
    """Writes all documents' ids in ascending key order below ``out``; gives that path.

    Texts are encoded once, and counted as they are; their ids are then dealt by ranges of keys, over as many shards as
    the ids fill. Null texts count as empty (the end id alone). Null keys come first; rows of equal keys stay rows of their
    own, in an order that their ids give; other columns are left out. An empty table gives empty files.
    """
    spark = docs.sparkSession
    width = 2 if load(path).get_vocab_size(with_added_tokens=True) <= 1 << 16 and end_id < 1 << 16 else 4
    encoded = cut(encode_all(docs, path, end_id, width, key, text), "ids", "zstd")
    # One row for each id of the vocabulary at most: bounded by the tokenizer, not by the input.
    found = np.array([(r.n, r.id) for r in id_counts(encoded).collect()], np.int64).reshape(-1, 2)
    ids = found[np.lexsort((found[:, 1], -found[:, 0])), 1]
    spark.createDataFrame([(ids.astype("<u4").tobytes(),)], "ids binary").coalesce(1).write.parquet(f"{out}/ranks")
    rank = np.zeros(int(ids.max(initial=0)) + 1, "<u4")
    rank[ids] = np.arange(len(ids))
    sent = spark.sparkContext.broadcast(rank)
    kind = encoded.schema["k"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, block = sent.value, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            shard, keys, given = batch.column(0)[0].as_py(), batch.column(1), batch.column(2)
            kind = np.int64 if given.type == pa.large_binary() else np.int32
            ends = np.frombuffer(given.buffers()[1], kind)[given.offset : given.offset + len(given) + 1] // width
            ranks = table[np.frombuffer(given.buffers()[2], f"<u{width}")[ends[0] : ends[-1]]]
            ends = ends - ends[0]
            at = 0
            while at < len(keys):
                to = min(at + BLOCK_DOCS, max(at + 1, int(np.searchsorted(ends, ends[at] + BLOCK_IDS))))
                to = min(to, len(keys))
                control, data = pack_ranks(ranks[ends[at] : ends[to]])
                columns = [pa.array([shard], pa.int32()), pa.array([block], pa.int32()), pa.ListArray.from_arrays([0, to - at], keys.slice(at, to - at)), pa.array([np.diff(ends[at : to + 1])], pa.list_(pa.int32())), pa.array([control], pa.binary()), pa.array([data], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["shard", "block", "keys", "lengths", "control", "data"])
                at, block = to, block + 1

    shards = shards or shard_count(int(found[:, 0].sum()), spark.sparkContext.defaultParallelism)
    # Documents of one key are in the order of their ids, so reruns agree; a key that very many have is dealt over several shards.
    dealt = encoded.filter("counts is null").select("k", "ids", F.xxhash64("ids").alias("h")).repartitionByRange(shards, "k", "h").sortWithinPartitions("k", "h", "ids").select(F.spark_partition_id().alias("shard"), "k", "ids")
    dealt.mapInArrow(run, f"shard int, block int, keys array<{kind}>, lengths array<int>, control binary, data binary").write.parquet(f"{out}/blocks")
    return out


def read_shards(spark: SparkSession, path: str, key: str = "doc_id", with_ids: bool = True) -> DataFrame:
    """Per document, from the files alone: key, start, n_tokens, ids_crc32 and, unless they aren't wanted, ids (binary, little-endian unsigned 32-bit)."""
    ranks = np.frombuffer(spark.read.parquet(f"{path}/ranks").first().ids, "<u4")
    sent = spark.sparkContext.broadcast(ranks)
    blocks = spark.read.parquet(f"{path}/blocks")
    # Where blocks start: sums of the shards in order (a row for each shard), then of the blocks of a shard.
    sizes = blocks.select("shard", "block", F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x).alias("n"))
    shard_sums = sizes.groupBy("shard").agg(F.sum("n").alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    bases = shard_sums.select(F.col("shard").alias("s"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shard_start"))
    inside = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("in_shard", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(bases, F.col("shard") == F.col("s")).select("shard", "block", (F.col("in_shard") + F.col("shard_start")).alias("base"))
    kind = blocks.schema["keys"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = sent.value
        for batch in batches:
            for k in range(batch.num_rows):
                row = {n: batch.column(n)[k].as_py() for n in ("shard", "block", "control", "data")}
                keys, lengths = batch.column("keys")[k].values, np.asarray(batch.column("lengths")[k].values).astype(np.int64)
                ids = np.ascontiguousarray(table[unpack_ranks(row["control"], row["data"], int(lengths.sum()))], "<u4")
                ends, raw, n = np.cumsum(lengths), memoryview(ids).cast("B"), len(lengths)
                sums = [crc(raw[4 * a : 4 * b]) for a, b in zip((ends - lengths).tolist(), ends.tolist(), strict=True)]
                columns = [pa.array([row["shard"]] * n, pa.int32()), pa.array([row["block"]] * n, pa.int32()), keys, pa.array(ends - lengths, pa.int64()), pa.array(lengths, pa.int64()), pa.array(sums, pa.int64())]
                if with_ids:
                    columns.append(binaries(ids, lengths))
                yield pa.RecordBatch.from_arrays(columns, names=["shard", "block", "k", "at", "n_tokens", "ids_crc32", "ids"][: len(columns)])

    docs = blocks.mapInArrow(run, f"shard int, block int, k {kind}, at long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids)
    joined = docs.join(starts, ["shard", "block"])
    return joined.select(F.col("k").alias(key), (F.col("base") + F.col("at")).alias("start"), "n_tokens", *["ids"] * with_ids, "ids_crc32")


def new_folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/askmill-shards-{uuid.uuid4().hex}"
