"""Near-duplicate vectors: randomly rotated binary codes bound each pair's inner product and say which pairs to compute exactly.

A unit vector x is rotated at random and kept as the signs of its coordinates, a code, with the factor
f = <code, x> for a code scaled to unit length. code / f is x but for an error of length sqrt((1 - f^2) / f^2) that is
orthogonal to x and points anywhere else alike. So the inner product of one rotation's code / f with another rotation's,
of another vector, estimates that of the vectors without bias, and codes alone, 48 bytes for a vector of 64 components, say what it can be.
A pair whose estimate lies below the threshold by more than its confidence bound is dropped; the vectors of
every other pair are fetched, and it is computed again in double precision.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from askmill.llm.common import cut, dealt, groups
from askmill.llm.components import components

#: Bits of a vector's codes, at least, by which inner products are estimated.
CODE_BITS = 256
#: Bits of a band, at least: more as a label has more vectors, so that a bucket of unlike vectors has about so many. Bands are as many as MISSED asks for.
BAND_BITS, BUCKET = 8, 256
#: The largest probability with which a pair at the threshold meets in no band.
MISSED = 1e-3
#: Errors within which an estimate is not trusted. At 5 a pair is dropped wrongly with a chance below 1e-6.
TRUST = 5.0
#: Vectors of a block that is compared with another block's.
BLOCK = 1024


@functools.lru_cache(maxsize=8)
def turns(d: int, bits: int = CODE_BITS, seed: int = 5) -> np.ndarray:
    """As many random orthogonal d x d matrices as so many bits ask for, two at least, side by side. More bits begin with the same matrices."""
    rng = np.random.default_rng(seed)
    return np.concatenate([np.linalg.qr(rng.normal(size=(d, d)))[0] for _ in range(max(2, -(-bits // d)))], 1)


def bands(bits: int, threshold: float) -> int:
    """How many bands of so many bits find a pair at the threshold but for MISSED: a bit of two unit vectors agrees as often as a random plane leaves them on one side."""
    agree = (1 - math.acos(max(-1.0, min(1.0, threshold))) / math.pi) ** bits
    return 1 if agree >= 1 else max(1, math.ceil(math.log(MISSED) / math.log1p(-agree)))


def encode(unit: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each unit vector the packed signs of its rotated coordinates, and a factor for each rotation."""
    y = unit @ turn
    return np.packbits(y > 0, axis=1), (np.abs(y).reshape(len(y), -1, unit.shape[1]).sum(2) / np.sqrt(unit.shape[1])).astype(np.float32)


def estimates(left: dict, right: dict, d: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Inner products of the coded unit vectors, (left, right), and their errors for pairs at the threshold or above.

    Of r rotations all pairs of different ones count: the sum over all of them less that over equal ones, whose errors aren't independent.
    """
    r = left["factors"].shape[1]
    guess = (left["sum"] @ right["sum"].T - left["scaled"] @ right["scaled"].T) / (r * (r - 1))
    wide = lambda f: ((1 - f**2) / f**2).max(1)
    el, er = wide(left["factors"])[:, None], wide(right["factors"])[None, :]
    single = 2 * (el + er) * max(0.0, 1 - threshold**2) / r
    return guess, np.sqrt((single + 2 * el * er / (r * (r - 1))) / max(1, d - 1))


def decoded(codes: list[bytes], turn: np.ndarray) -> dict:
    """What ``linked`` takes of codes of one length and width of bands: factors, scaled (signs by factors), sum (of all rotations, turned back), keys."""
    raw = np.frombuffer(b"".join(codes), np.uint8).reshape(len(codes), -1)
    d, bits = raw[0, :8].view("<i4").tolist()
    r = turn.shape[1] // d
    signs = np.unpackbits(raw[:, 8 + 4 * r :], axis=1)
    f = np.clip(np.ascontiguousarray(raw[:, 8 : 8 + 4 * r]).view("<f4"), 1e-6, 1)
    scaled = (signs[:, : turn.shape[1]].astype(np.float32) * 2 - 1) / np.repeat(f * np.float32(np.sqrt(d)), d, axis=1)
    n = signs.shape[1] // bits
    return {"factors": f, "scaled": scaled, "sum": scaled @ turn.T.astype(np.float32), "keys": signs[:, : n * bits].reshape(len(codes), n, bits) @ (1 << np.arange(bits))}


def possible(left: dict, right: dict, d: int, threshold: float, band: int) -> np.ndarray:
    """Which pairs (left, right) may link by their codes and meet in no band before ``band``: a boolean matrix."""
    guess, error = estimates(left, right, d, threshold)
    open_ = guess + TRUST * error + 1e-4 >= threshold
    a, b = np.nonzero(open_)
    for k in range(band):
        met = left["keys"][a, k] == right["keys"][b, k]
        open_[a[met], b[met]] = False
        a, b = a[~met], b[~met]
    return open_


def exact(open_: np.ndarray, left: np.ndarray, right: np.ndarray, threshold: float) -> np.ndarray:
    """Which of the open pairs link, by the unit vectors themselves."""
    n = int(open_.sum())
    if n > 0.05 * open_.size:
        return open_ & (left @ right.T >= threshold)
    if n:
        open_ = open_.copy()
        a, b = np.nonzero(open_)
        open_[a, b] = np.einsum("nd,nd->n", left[a], right[b]) >= threshold
    return open_


def forest(yes: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each left and right row the smallest id that links of this matrix lead to: a link each, not one for each pair."""
    most = np.iinfo(np.int64).max
    l, r = left.copy(), right.copy()
    while True:
        l2 = np.minimum(l, np.where(yes, r[None, :], most).min(1))
        r2 = np.minimum(r, np.where(yes, l2[:, None], most).min(0))
        if (l2 == l).all() and (r2 == r).all():
            return l, r
        l, r = l2, r2


def _coded(reps: DataFrame, threshold: float) -> DataFrame:
    """kind, d, bits, r, code (d, bits, factors, signs of all rotations and bands), keys (each band's bits)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, bits = np.asarray(batch.column("d")), np.asarray(batch.column("bits"))
            codes: list[bytes] = [b""] * len(sizes)
            keys: list[np.ndarray] = [np.empty(0, np.int32)] * len(sizes)
            for d, b in sorted(set(zip(sizes.tolist(), bits.tolist(), strict=True))):
                at = np.flatnonzero((sizes == d) & (bits == b))
                unit = _unit(batch.column("emb").take(pa.array(at)), d)
                n, base = bands(b, threshold), turns(d).shape[1]
                turn = turns(d, max(CODE_BITS, n * b))[:, : max(base, n * b)]
                factors = encode(unit, turn[:, :base])[1]
                signs = unit @ turn > 0
                packed = np.packbits(signs, axis=1)
                head = np.array([d, b], "<i4").tobytes()
                own = (signs[:, : n * b].reshape(len(at), n, b) @ (1 << np.arange(b))).astype(np.int32)
                for k, i in enumerate(at):
                    codes[i], keys[i] = head + factors[k].astype("<f4").tobytes() + packed[k].tobytes(), own[k]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("kind", "d", "bits", "r")] + [pa.array(codes, pa.binary()), pa.array(keys, pa.list_(pa.int32()))], names=["kind", "d", "bits", "r", "code", "keys"])

    return reps.select("kind", "d", "bits", "r", "emb").mapInArrow(run, "kind long, d int, bits int, r long, code binary, keys array<int>")


def _unit(lists: pa.Array, d: int) -> np.ndarray:
    """Vectors of d components, none of them zero, scaled to unit length; the largest component comes to one first, as squares may overflow."""
    x = np.asarray(lists.flatten(), np.float64).reshape(len(lists), d)
    unit = x / np.abs(x).max(1, keepdims=True)
    return unit / np.linalg.norm(unit, axis=1, keepdims=True)


#: A unit of comparison: a label's vectors of one length, a band with its bits, and two blocks of those that have them.
UNIT = ["kind", "place", "pair"]


def _units(coded: DataFrame) -> DataFrame:
    """A row for each band of a vector and each pair of blocks of its bucket that holds its own block: kind, place (band, bits), pair (i, j), own, r, code.

    Rows are narrow: no vector is among them, and of a code only the factors, the rotations' signs and the bands before this one.
    """
    base = F.col("d") * F.greatest(F.lit(2), F.ceil(F.lit(CODE_BITS) / F.col("d")))
    rows = coded.select("kind", "d", "bits", "r", "code", F.posexplode("keys").alias("band", "key"))
    length = 8 + 4 * (base / F.col("d")) + F.ceil(F.greatest(base, F.col("band") * F.col("bits")) / 8)
    rows = rows.select("kind", (F.shiftleft(F.col("band").cast("long"), 32) + F.col("key")).alias("place"), "r", F.substring("code", F.lit(1), length.cast("int")).alias("code"))
    by = ["kind", "place"]
    large = cut(rows.groupBy(*by).agg(F.count("*").alias("size")).filter(F.col("size") > BLOCK), "large")
    sizes = F.broadcast(large) if large.limit(100_001).count() <= 100_000 else large
    rows = rows.join(sizes, by, "left").withColumn("blocks", F.ceil(F.coalesce("size", F.lit(1)) / BLOCK)).withColumn("own", F.pmod(F.xxhash64("r", F.lit(3)), F.col("blocks")))
    pair = F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda k: F.shiftleft(F.least(k, F.col("own")), 32) + F.greatest(k, F.col("own")))
    return rows.select(*by, "own", "r", "code", F.explode(pair).alias("pair"))


def _sides(rows: pa.Table, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """Of a unit's rows those of the left block and of the right one, and which pairs of them are open: a symmetric matrix if the blocks are one."""
    pair, own = rows.column("pair")[0].as_py(), np.asarray(rows.column("own"))
    i, j = pair >> 32, pair & 0xFFFFFFFF
    a, b = np.flatnonzero(own == i), np.flatnonzero(own == j)
    if not len(a) or not len(b) or rows.num_rows < 2:
        return None
    codes = rows.column("code").to_pylist()
    d = int.from_bytes(codes[0][:4], "little")
    every = decoded(codes, turns(d))
    side = lambda at: {k: v[at] for k, v in every.items()}
    open_ = possible(side(a), side(b), d, threshold, rows.column("place")[0].as_py() >> 32)
    if i == j:
        open_ |= open_.T
        np.fill_diagonal(open_, False)
    return (a, b, open_) if open_.any() else None


def _involved(units: DataFrame, threshold: float) -> DataFrame:
    """The rows of ``units`` that their codes leave a link possible with another row of theirs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in groups(batches, UNIT):
            if sides := _sides(rows, threshold):
                a, b, open_ = sides
                yield from rows.take(pa.array(np.union1d(a[open_.any(1)], b[open_.any(0)]))).combine_chunks().to_batches()

    return dealt(units.select(*UNIT, "own", "r", "code"), *UNIT).mapInArrow(run, "kind long, place long, pair long, own long, r long, code binary")


def _compare(involved: DataFrame, reps: DataFrame, threshold: float) -> DataFrame:
    """id, n (vectors linked in this unit), to (the smallest id reached there). Vectors come to the open rows alone."""

    def unit_of(rows: pa.Table) -> tuple | None:
        sides = _sides(rows, threshold)
        if not sides:
            return None
        a, b, open_ = sides
        vectors = rows.column("emb").combine_chunks()
        unit = _unit(vectors, len(vectors[0]))
        ids, copies = np.asarray(rows.column("id")), np.asarray(rows.column("copies"))
        yes = exact(open_, unit[a], unit[b], threshold)
        n, to = np.zeros(len(ids), np.int64), ids.copy()
        n[a] = yes @ copies[b]
        n[b] = copies[a] @ yes
        to[a], to[b] = forest(yes, ids[a], ids[b])
        at = np.flatnonzero(n)
        return (ids[at], n[at], to[at]) if len(at) else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple] = []

        def give() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in zip(*found, strict=True)], names=["id", "n", "to"])

        for rows in groups(batches, UNIT):
            if x := unit_of(rows):
                found.append(x)
            if len(found) == 1000:
                yield give()
                found.clear()
        if found:
            yield give()

    wide = involved.join(reps.select("r", "id", "copies", "emb"), "r").select(*UNIT, "own", "code", "id", "copies", "emb")
    return dealt(wide, *UNIT).mapInArrow(run, "id long, n long, to long")


def near_vectors(table: DataFrame, threshold: float = 0.93, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """Per row: key, n_links, component_id, kept.

    Rows of equal labels whose vectors have a cosine of at least ``threshold`` are linked. A null label links with
    nothing, nor do vectors that are null, zero, or hold a null or non-finite component; vectors of different
    lengths don't either. Labels may be of any simple type. Equal vectors become one first and count as often as they occur. A pair is compared where a band of
    its bits is equal, in the first such band only: eight bits and 16 bands find a pair at 0.93 with probability
    0.9992, closer ones more surely. A label of more than 65,536 vectors has wider bands, and more of them, for the same probability, so that buckets of
    unlike vectors stay small; only vectors that are alike share large ones, and their links must all be counted. A null key has component null and is
    kept. An empty table gives an empty table.
    """
    rows = table.select(F.col(key).cast("long").alias("id"), F.col(label).cast("string").alias("label"), F.col(vector).cast("array<double>").alias("emb"))
    fine = F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("emb").isNotNull() & F.forall("emb", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("emb", lambda x: x != 0)
    rows = rows.withColumn("fine", F.coalesce(fine, F.lit(False)))
    valid = rows.filter("fine").drop("fine")
    reps = valid.groupBy("label", "emb").agg(F.min("id").alias("id"), F.count("*").alias("copies")).withColumn("d", F.size("emb"))
    reps = cut(reps.withColumn("r", F.monotonically_increasing_id()), "vectors")
    # A row for each label and length of vectors, numbered once for all tasks.
    sizes = reps.groupBy(F.col("label").alias("l"), F.col("d").alias("s")).agg(F.count("*").alias("of"))
    width = F.greatest(F.lit(BAND_BITS), F.least(F.lit(30), F.ceil(F.log2(F.col("of") / BUCKET)))).cast("int")
    sizes = cut(sizes.withColumn("kind", F.monotonically_increasing_id()), "kinds")
    sizes = F.broadcast(sizes) if sizes.limit(100_001).count() <= 100_000 else sizes
    sized = reps.join(sizes, (F.col("label") == F.col("l")) & (F.col("d") == F.col("s"))).withColumn("bits", width)
    involved = cut(_involved(_units(cut(_coded(sized, threshold), "codes")), threshold), "involved")
    found = cut(_compare(involved, reps, threshold), "compared")
    counts = found.groupBy("id").agg(F.sum("n").alias("linked"))
    joined = components(found.select(F.col("id").alias("a"), F.col("to").alias("b")).distinct()).withColumnRenamed("node", "id")
    named = reps.select("label", "emb", "copies", "id").join(counts, "id", "left").join(joined, "id", "left")
    named = named.select("label", "emb", (F.col("copies") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    out = valid.join(named, ["label", "emb"]).select("id", "n_links", "component_id")
    alone = rows.filter("not fine").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return out.unionByName(alone).select(F.col("id").alias(key), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))
