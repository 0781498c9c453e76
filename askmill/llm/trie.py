"""The trie of conversations' prefixes: who shares which opening turns, and what sharing them saves.

Turns are numbered in their conversation, conversations are rebuilt on the opening of a base conversation, and each prefix gets a
polynomial rolling fingerprint by numpy scans. Equal fingerprints of a depth are candidates for one node: each group's turns and parents are held
against those of its representative, and what differs is split off with all that follows it, until no group holds two different prefixes.

Sums over subtrees need no round for each depth. A node is represented by its member that comes first by a hash, and the nodes
of one representative are a chain. Whatever hangs on a chain's node passes its sums to it, chain by chain: with members in random order a
path crosses some log(members) chains, however deep it is. A conversation of any length is dealt over tasks in blocks of turns.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from askmill.llm.common import cut, dealt, running_total

#: Fingerprints are modulo two primes below 2^31, with a base each.
PRIMES, BASES = (2147483647, 2147483629), (911382323, 972663749)
#: Positions of a block (a power of two).
BLOCK = 512
#: Ids of a row of what ends at a node.
ENDS = 4096
EMPTY = hashlib.sha256(b"").hexdigest()
NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def _ranks(new: np.ndarray, carry: int) -> np.ndarray:
    """How many rows of its run come before each row; ``new`` marks where runs start, ``carry`` rows of the first one came in earlier batches."""
    at = np.arange(len(new))
    first = np.maximum.accumulate(np.where(new, at, -1))
    return np.where(first < 0, at + carry, at - first)


def numbered(turns: DataFrame) -> DataFrame:
    """conv_id, d (from 0), role, text: each turn's place in its conversation, by turn (null first), then by a checksum of role and text.

    Rows are sorted by ranges, so a long conversation lies in many partitions. Each counts its own rows; only the first conversation of a
    partition can have rows before it, so what is added to it is a table of at most one row for each partition.
    """
    n = max(int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    clean = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    rows = turns.filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("turn"), clean("role"), clean("text"))
    rows = rows.withColumn("h", F.xxhash64("role", "text"))
    rows = rows.repartitionByRange(n, "conv_id", "turn", "h").sortWithinPartitions("conv_id", "turn", "h", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, carry = None, 0
        for batch in batches:
            conv = np.asarray(batch.column(0))
            if not len(conv):
                continue
            new = np.r_[conv[0] != last if last is not None else True, conv[1:] != conv[:-1]]
            rank = _ranks(new, carry)
            last, carry = conv[-1], int(rank[-1]) + 1
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(rank), batch.column(2), batch.column(3)], names=["conv_id", "part", "rank", "role", "text"])

    found = rows.select("conv_id", F.spark_partition_id().alias("part"), "role", "text").mapInArrow(run, "conv_id long, part int, rank long, role string, text string")
    found = cut(found, "turns")
    counts = found.groupBy("conv_id", "part").agg(F.count("*").alias("n"))
    ahead = F.sum("n").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    base = counts.withColumn("ahead", ahead).filter("ahead > 0").select("conv_id", "part", "ahead")
    return found.join(F.broadcast(base), ["conv_id", "part"], "left").select("conv_id", (F.col("rank") + F.coalesce("ahead", F.lit(0))).alias("d"), "role", "text")


def conversations(turns: DataFrame) -> DataFrame:
    """conv_id, h, base, shift, length of each conversation: it takes the first ``shift`` turns of ``base``, ``h`` if there are so many, then its own from ``h`` on."""
    own = turns.groupBy("conv_id").agg((F.max("d") + 1).alias("n"))
    own = own.withColumns({"h": F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9, "base": F.col("conv_id") - F.col("conv_id") % 5})
    bases = own.select(F.col("conv_id").alias("base"), F.col("n").alias("of"))
    rows = own.join(bases, "base", "left").withColumn("shift", F.least("h", F.coalesce("of", F.lit(0))))
    return cut(rows.select("conv_id", "h", "base", "shift", (F.col("shift") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length")), "conversations")


def rebuilt(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """conv_id, d, role, text of the rebuilt conversations. A base's opening turns go to the few conversations that take them."""
    own = turns.join(convs.select("conv_id", "h", "shift"), "conv_id").filter("d >= h").select("conv_id", (F.col("d") - F.col("h") + F.col("shift")).alias("d"), "role", "text")
    heads = turns.filter("d < 8").withColumnRenamed("conv_id", "base").join(convs.select("conv_id", "h", "base"), "base").filter("d < h")
    return own.unionByName(heads.select("conv_id", "d", "role", "text"))


def _power(base: int, exponents: np.ndarray, prime: int) -> np.ndarray:
    out, square, e = np.ones(len(exponents), np.uint64), np.uint64(base % prime), exponents.astype(np.uint64)
    while e.any():
        out = np.where(e & np.uint64(1), out * square % np.uint64(prime), out)
        square, e = square * square % np.uint64(prime), e >> np.uint64(1)
    return out


def fingerprints(rows: DataFrame, primes: tuple[int, int] = PRIMES) -> DataFrame:
    """Adds f and pf, the fingerprints of the prefix that ends with a turn and of the one before it.

    A block's prefixes are a scan of its turns' terms; the totals of the blocks before, of which there are any only in long conversations, are added.
    """
    rows = rows.withColumns({"block": F.shiftright("d", BLOCK.bit_length() - 1), "t": F.xxhash64("role", "text"), "u": F.xxhash64("text", "role", F.lit("other"))})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, carry = None, [0, 0]
        for batch in batches:
            if not batch.num_rows:
                continue
            conv, block, d = (np.asarray(batch.column(c)) for c in ("conv_id", "block", "d"))
            new = np.r_[(conv[0], block[0]) != last, (conv[1:] != conv[:-1]) | (block[1:] != block[:-1])]
            first = np.maximum.accumulate(np.where(new, np.arange(len(new)), -1))
            last, out = (conv[-1], block[-1]), []
            for k, (prime, base) in enumerate(zip(primes, BASES, strict=True)):
                p = np.uint64(prime)
                term = np.asarray(batch.column("tu"[k])).astype(np.uint64) % p * _power(base, d + 1, prime) % p
                total = np.cumsum(term)
                start = np.where(first > 0, total[np.maximum(first, 1) - 1], np.uint64(0))
                before = (total - start - term + np.where(first < 0, np.uint64(carry[k]), np.uint64(0))) % p
                here = (before + term) % p
                carry[k] = int(here[-1])
                out += [pa.array(here.astype(np.int64)), pa.array(before.astype(np.int64))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("conv_id", "d", "block", "role", "text")), *out], names=["conv_id", "d", "block", "role", "text", "f0", "p0", "f1", "p1"])

    scanned = dealt(rows.select("conv_id", "block", "d", "role", "text", "t", "u"), "conv_id", "block", order=("d",))
    scanned = cut(scanned.mapInArrow(run, "conv_id long, d long, block long, role string, text string, f0 long, p0 long, f1 long, p1 long"), "prefixes")
    join = lambda a, b: (F.shiftleft(a, 31) + b)
    short = scanned.filter("block = 0").select("conv_id", "d", "role", "text", join(F.col("f0"), F.col("f1")).alias("f"), join(F.col("p0"), F.col("p1")).alias("pf"))
    ends = scanned.filter((F.col("d") + 1) % BLOCK == 0)
    w = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    base = ends.select("conv_id", (F.col("block") + 1).alias("block"), (F.sum("f0").over(w) % primes[0]).alias("b0"), (F.sum("f1").over(w) % primes[1]).alias("b1"))
    both = lambda a: join((F.col(f"{a}0") + F.col("b0")) % primes[0], (F.col(f"{a}1") + F.col("b1")) % primes[1])
    long = scanned.filter("block > 0").join(base, ["conv_id", "block"]).select("conv_id", "d", "role", "text", both("f").alias("f"), both("p").alias("pf"))
    return short.unionByName(long)


#: What a node is known by until it has its members: depth, fingerprint, and what was split off; and its parent's.
KEY, PARENT = ["depth", "f", "s"], ["pf", "ps"]


def _first(c: str = "conv_id") -> Column:
    """The member that represents a node: the first by a hash, so that chains are long."""
    return F.min(F.struct(F.xxhash64(F.lit("chain"), c).alias("h"), F.col(c).alias("c")))


def verified(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows with s and ps, which tell apart prefixes of equal fingerprints, and the nodes.

    Rows of one group and equal role, text and parent are counted together before they are shuffled. A group with a second kind of them had
    a collision: all kinds but that of its representative, the smallest conversation, are split off, and so is what follows in the
    conversations that have them. Equal prefixes always stay together, and each round leaves fewer collisions, until there are none.
    """
    rows = rows.withColumnRenamed("d", "depth").withColumns({"depth": F.col("depth") + 1, "s": F.lit(0).cast("long"), "ps": F.lit(0).cast("long")})
    while True:
        kinds = cut(rows.groupBy(*KEY, *PARENT, "role", "text").agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id"), _first().alias("chain")), "kinds")
        twice = kinds.groupBy(*KEY).agg(F.count("*").alias("n")).filter("n > 1")
        if twice.isEmpty():
            nodes = kinds.select(*KEY, *PARENT, "n_convs", "conv_id", F.col("chain.c").alias("chain"), F.octet_length("text").alias("bytes"))
            return rows, nodes
        order = Window.partitionBy(*KEY).orderBy("conv_id", "pf", "ps", "role", "text")
        other = kinds.join(twice.select(*KEY), KEY, "left_semi").withColumn("k", F.row_number().over(order)).filter("k > 1")
        other = other.select(*KEY, *PARENT, "role", "text", F.col("conv_id").alias("name"))
        hits = rows.join(other, [*KEY, *PARENT, "role", "text"]).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("depth", "name"))).alias("hits"))
        mixed = lambda s, upto: F.aggregate(F.filter(F.coalesce("hits", F.array().cast("array<struct<depth:bigint,name:bigint>>")), lambda x: x["depth"] <= upto), F.col(s), lambda a, x: F.xxhash64(a, x["depth"], x["name"]))
        rows = rows.join(hits, "conv_id", "left").withColumns({"s": mixed("s", F.col("depth")), "ps": mixed("ps", F.col("depth") - 1)}).drop("hits")
        rows = cut(rows, "split")


def _hashes(ends: DataFrame) -> DataFrame:
    """The key of each node where conversations end, and the SHA-256 of their ids, ascending, joined by commas.

    Sorted by ranges, so a node where very many end lies in many partitions; these pack its ids in rows, which one hash then takes up in order.
    """
    n = max(int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    rows = ends.repartitionByRange(n, *KEY, "conv_id").sortWithinPartitions(*KEY, "conv_id")

    def runs(batch: pa.RecordBatch, columns: list[str]) -> Iterator[tuple[tuple, int, int]]:
        keys = [np.asarray(batch.column(c)) for c in columns]
        cuts = np.flatnonzero(np.logical_or.reduce([k[1:] != k[:-1] for k in keys])) + 1
        for a, b in zip(np.r_[0, cuts], np.r_[cuts, batch.num_rows], strict=True):
            yield tuple(int(k[a]) for k in keys), int(a), int(b)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            ids = batch.column("conv_id").to_pylist()
            for key, a, b in runs(batch, KEY) if batch.num_rows else ():
                out += [(*key, ids[k], ",".join(map(str, ids[k : min(b, k + ENDS)]))) for k in range(a, b, ENDS)]
            columns = list(zip(*out, strict=True)) if out else [()] * 5
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:4]), pa.array(columns[4], pa.string())], names=[*KEY, "at", "ids"])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = None, None

        def done(found: list) -> pa.RecordBatch:
            columns = list(zip(*found, strict=True)) if found else [()] * 4
            return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.string())], names=[*KEY, "ends_sha256"])

        for batch in batches:
            out, texts = [], batch.column("ids").to_pylist()
            for key, a, b in runs(batch, KEY) if batch.num_rows else ():
                if key != last:
                    if last is not None:
                        out.append((*last, state.hexdigest()))
                    last, state, text = key, hashlib.sha256(), ""
                else:
                    text = ","
                state.update((text + ",".join(texts[a:b])).encode())
            yield done(out)
        if last is not None:
            yield done([(*last, state.hexdigest())])

    packed = rows.select(*KEY, "conv_id").mapInArrow(pack, "depth long, f long, s long, at long, ids string")
    return dealt(packed, *KEY, order=("at",)).mapInArrow(digest, "depth long, f long, s long, ends_sha256 string")


def _subtrees(nodes: DataFrame) -> DataFrame:
    """chain, depth of each node with n_leaves and saved_tokens, summed over its subtree. ``nodes``: chain, depth, up (the parent's chain), leaf, saved."""
    own = nodes.groupBy("chain").agg(F.min(F.struct("depth", "up")).alias("top"), F.sum("leaf").alias("leaf"), F.sum("saved").alias("saved"))
    chains = cut(own.select("chain", F.col("top.up").alias("up"), (F.col("top.depth") - 1).alias("at"), "leaf", "saved"), "chains")
    onto = chains.filter("up is not null").select("chain", "up", "at")
    flows = []
    now = chains.filter("up is not null").groupBy(F.col("up").alias("chain"), F.col("at").alias("depth")).agg(F.sum("leaf").alias("leaf"), F.sum("saved").alias("saved"))
    while True:
        now = cut(now, "flows")
        if now.isEmpty():
            break
        flows.append(now)
        summed = now.groupBy("chain").agg(F.sum("leaf").alias("leaf"), F.sum("saved").alias("saved"))
        now = summed.join(onto, "chain").groupBy(F.col("up").alias("chain"), F.col("at").alias("depth")).agg(F.sum("leaf").alias("leaf"), F.sum("saved").alias("saved"))
    every = nodes.select("chain", "depth", "leaf", "saved")
    for flow in flows:
        every = every.unionByName(flow)
    every = cut(every.groupBy("chain", "depth").agg(F.sum("leaf").alias("leaf"), F.sum("saved").alias("saved")), "sums")
    every = every.withColumns({"back": -F.col("depth"), "bucket": -F.shiftright("depth", BLOCK.bit_length() - 1)})
    for c in ("leaf", "saved"):
        every = running_total(every, ["chain"], ["back"], c, f"below_{c}", "bucket")
    return every.select("chain", "depth", (F.col("leaf") + F.col("below_leaf")).alias("n_leaves"), (F.col("saved") + F.col("below_saved")).alias("saved_tokens"))


def prefix_trie(turns: DataFrame, primes: tuple[int, int] = PRIMES) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256: a row for each prefix of the rebuilt conversations.

    Rows without a conv_id belong to no conversation. Null roles and texts are empty; turns of equal number are ordered by a checksum, repeated
    ones stay. A conversation may come out without turns: it ends at the root. Without conversations there are no nodes, not even a root. Columns besides
    conv_id, turn, role and text are left out.
    """
    own = cut(numbered(turns.select("conv_id", "turn", "role", "text")), "numbered")
    convs = conversations(own)
    rows, kinds = verified(fingerprints(rebuilt(own, convs), primes))
    zero = [F.lit(0).cast("long").alias(c) for c in KEY]
    root = convs.agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id"), _first()["c"].alias("chain")).filter("n_convs > 0")
    root = root.select(*zero, *[F.lit(None).cast("long").alias(c) for c in PARENT], "n_convs", "conv_id", "chain", F.lit(0).alias("bytes"))
    nodes = cut(kinds.unionByName(root), "nodes")
    # Each node with its parent; a parent with very many children is split by the join.
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("f").alias("pf"), F.col("s").alias("ps"), F.col("conv_id").alias("parent_conv_id"), F.col("chain").alias("up"))
    children = nodes.filter("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("pf").alias("f"), F.col("ps").alias("s")).agg(F.count("*").alias("n_children"))
    last = convs.select("conv_id", F.col("length").alias("depth"))
    ends = rows.select("conv_id", *KEY).join(last, ["conv_id", "depth"]).select(*KEY, "conv_id").unionByName(last.filter("depth = 0").select(*zero, "conv_id"))
    known = nodes.join(children, KEY, "left").join(_hashes(ends), KEY, "left").join(parents, ["depth", *PARENT], "left")
    n = F.coalesce("n_children", F.lit(0)).cast("long")
    known = cut(known.select("conv_id", "depth", "parent_conv_id", "n_convs", n.alias("n_children"), F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"), "chain", "up", (n == 0).cast("long").alias("leaf"), ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved")), "known")
    # A node below one of the same chain is within it; the others are their chain's top.
    sums = _subtrees(known.select("chain", "depth", "up", "leaf", "saved"))
    out = known.drop("leaf", "saved", "up").join(sums, ["chain", "depth"])
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
