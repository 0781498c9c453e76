"""Near-duplicate documents: HyperMinHash sketches choose candidates, whole shingle sets confirm them."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from askmill.llm.common import cut, dealt, groups
from askmill.llm.components import components
from askmill.llm.words import ascii_words, hashes, slices

#: Buckets of a sketch; mantissa bits of a register.
BUCKETS, MANTISSA = 256, 10
#: The largest probability with which a pair at the threshold meets in no band.
MISSED = 1e-4
#: Standard errors by which an estimate may fall short of the threshold before a pair is dropped unconfirmed.
SLACK = 5.0
#: Rows of a block in which the members of a band's bucket are compared with another block's.
BLOCK = 512
#: Keys that each executor may be sent to choose texts (8 bytes each); more are joined by shuffle.
MOST_SENT = 4_000_000

_PLACE_BITS = 64 - 8  # below the eight bits that choose one of the 256 buckets
_rng = np.random.default_rng(1)
#: For each bucket, in which other buckets to look for a register if it is empty.
_PROBES = np.stack([_rng.permutation(BUCKETS) for _ in range(BUCKETS)])


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (multiply and shift, three times)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def missed(percent: int, rows: int) -> float:
    """The probability with which a pair of this similarity meets in no band of so many registers."""
    return (1 - (percent / 100) ** rows) ** (BUCKETS // rows)


def band_rows(percent: int) -> int:
    """Registers of a band: as many as the threshold allows, 8 at 85 per cent and 6 at 80."""
    return max((r for r in range(1, 17) if missed(percent, r) <= MISSED), default=1)


def shingle_sets(texts: pa.Array, size: int) -> Iterator[np.ndarray]:
    """Each text's set of shingles as sorted distinct 64-bit hashes. Texts are worked on a slice at a time, all words of a slice at once.

    Words are runs without ASCII white space, A-Z in small letters. Fewer words than ``size`` make one shingle
    of them all; no words, or no text, make none.
    """
    odd = np.array([(0x9E3779B97F4A7C15 * (2 * k + 1)) % 2**64 | 1 for k in range(size)], np.uint64)
    for part in slices(texts):
        number, sizes, distinct = ascii_words(part)
        h = hashes(distinct)[number]
        total = np.full(max(len(h) - size + 1, 0), size, np.uint64)
        for k in range(size):
            total = mixed(total + odd[k] * h[k : k + len(total)])
        starts = np.cumsum(sizes) - sizes
        short = {}
        for n in range(1, size):
            of = np.flatnonzero(sizes == n)
            x = np.full(len(of), n, np.uint64)
            for k in range(n):
                x = mixed(x + odd[k] * h[starts[of] + k])
            short |= dict(zip(of.tolist(), x, strict=True))
        for k, (at, n) in enumerate(zip(starts.tolist(), sizes.tolist(), strict=True)):
            yield np.unique(total[at : at + n - size + 1]) if n >= size else np.array([short[k]], np.uint64) if n else np.zeros(0, np.uint64)


def registers(hashes: np.ndarray) -> np.ndarray:
    """uint16 x BUCKETS: in each bucket of a non-empty set the smallest hash, as leading zeros and MANTISSA bits after the first one.

    The hashes are sorted, so a bucket's first is its smallest. An empty bucket takes the register of the first
    full one in its own order of the others, so that two sets agree there, too, as often as they overlap.
    """
    bucket = (hashes >> np.uint64(_PLACE_BITS)).astype(np.int64)
    first = np.flatnonzero(np.diff(bucket, prepend=-1))
    low = hashes[first] & np.uint64((1 << _PLACE_BITS) - 1)
    bits = np.frexp(low.astype(np.float64))[1].astype(np.int64)  # 0 for 0
    zeros = _PLACE_BITS - bits
    shift = np.maximum(0, bits - 1 - MANTISSA).astype(np.uint64)
    mantissa = (low >> shift) & np.uint64((1 << MANTISSA) - 1)
    full = np.zeros(BUCKETS, bool)
    full[bucket[first]] = True
    out = np.zeros(BUCKETS, np.uint16)
    out[bucket[first]] = (zeros << MANTISSA).astype(np.uint16) | mantissa.astype(np.uint16)
    if not full.all():
        empty = np.flatnonzero(~full)
        order = _PROBES[empty]
        source = order[np.arange(len(empty)), full[order].argmax(axis=1)]
        out[empty] = out[source]
    return out


def collision(na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """How often registers of different hashes are equal: both minima have as many leading zeros, and the mantissa bits meet."""
    edges = np.r_[2.0 ** -np.arange(0, 40), 0.0]  # a minimum in [edges[i + 1], edges[i]) has i leading zeros

    def shares(n: np.ndarray) -> np.ndarray:
        per = np.maximum(1.0, n / BUCKETS)[:, None]
        above = (1 - edges[None, :]) ** per
        return above[:, 1:] - above[:, :-1]

    return (shares(na) * shares(nb)).sum(1) / (1 << MANTISSA)


def estimate(equal: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """The Jaccard similarity from the share of equal registers, corrected for chance collisions."""
    c = collision(na, nb)
    return np.clip((equal / BUCKETS - c) / (1 - c), 0, 1)


def may_link(equal: np.ndarray, na: np.ndarray, nb: np.ndarray, percent: int) -> np.ndarray:
    """Whether sizes allow the similarity and the estimate isn't SLACK standard errors below it. Small sets have larger errors."""
    t = percent / 100
    few, many = np.minimum(na, nb), np.maximum(na, nb)
    error = np.sqrt(t * (1 - t) / np.clip(few, 1, BUCKETS))
    return (100 * few >= percent * many) & (estimate(equal, na, nb) >= t - SLACK * error)


def sketches(docs: DataFrame, size: int, key: str, text: str) -> DataFrame:
    """id, n, d1, d2 (a checksum of the whole set, 128 bits), regs (null for an empty set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, d, regs = [], [], []
            for h in shingle_sets(batch.column(1), size):
                n.append(len(h))
                d.append(hashlib.blake2b(h, digest_size=16).digest())
                regs.append(registers(h).tobytes() if len(h) else None)
            d = np.frombuffer(b"".join(d), "<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(d[:, 0]), pa.array(d[:, 1]), pa.array(regs, pa.binary())], names=["id", "n", "d1", "d2", "regs"])

    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("t"))
    return rows.mapInArrow(run, "id long, n long, d1 long, d2 long, regs binary")


def band_keys(reps: DataFrame, n: int) -> DataFrame:
    """A row for each band of ``n`` registers of each set: band, key, and the set's columns but its registers. Equal bands have equal keys."""
    bands = F.transform(F.sequence(F.lit(0), F.lit(BUCKETS // n - 1)), lambda b: F.struct(b.alias("band"), F.xxhash64(b, F.substring(F.col("regs"), b * 2 * n + 1, F.lit(2 * n))).alias("key")))
    return reps.select("id", F.inline(bands))


def _equal(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a == b).sum(-1)


def _regs(x: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(x), np.uint16).reshape(-1, BUCKETS)


def likely(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sketches leave a link possible."""
    side = lambda c: reps.select(F.col("id").alias(c), F.col("n").alias(f"n{c}"), F.col("regs").alias(f"r{c}"))
    rows = pairs.join(side("a"), "a").join(side("b"), "b")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            if len(p):
                ok = may_link(_equal(_regs(p.ra), _regs(p.rb)), p.na.to_numpy(), p.nb.to_numpy(), percent)
                yield p.loc[ok, ["a", "b"]]

    return rows.select("a", "b", "na", "nb", "ra", "rb").mapInPandas(run, "a long, b long").distinct()


def confirmed(pairs: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole shingle sets link: 100 * intersection >= percent * union. ``docs``: id, t."""
    texts = texts_of(pairs.select(F.explode(F.array("a", "b")).alias("id")), docs)
    rows = pairs.join(texts.select(F.col("id").alias("a"), F.col("t").alias("ta")), "a").join(texts.select(F.col("id").alias("b"), F.col("t").alias("tb")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, keep = 0, []
            for part in slices(pc.binary_join_element_wise(batch.column(2), batch.column(3), "")):
                ta, tb = (batch.column(c).slice(at, len(part)) for c in (2, 3))
                # A leader stands in many pairs: its set is made once.
                texts = pa.concat_arrays([ta, tb]).dictionary_encode()
                sets = list(shingle_sets(texts.dictionary, size))
                of = texts.indices.to_pylist()
                for i, j in zip(of[: len(part)], of[len(part) :], strict=True):
                    both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                    keep.append(100 * both >= percent * (len(sets[i]) + len(sets[j]) - both))
                at += len(part)
            part = batch.filter(pa.array(keep, pa.bool_()))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1)], names=["a", "b"])

    return rows.select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def texts_of(ids: DataFrame, docs: DataFrame) -> DataFrame:
    """The rows (id, t) of ``docs`` that ``ids`` name: by sending the ids while they are few, else by shuffle."""
    ids = cut(ids.distinct(), "ids")
    return docs.join(F.broadcast(ids) if ids.count() <= MOST_SENT else ids, "id", "left_semi")


def _open(rows: pa.Table, percent: int) -> list[tuple[int, np.ndarray]]:
    """Of a pair of blocks the rows with those that their sketches let them link to: of another part, and in the first band in which they meet."""
    band, i, j = (rows.column(c)[0].as_py() for c in ("band", "i", "j"))
    ids, parts, own, n = (np.asarray(rows.column(c)) for c in ("id", "part", "own", "n"))
    regs, per = np.frombuffer(b"".join(rows.column("regs").to_pylist()), np.uint16).reshape(len(ids), BUCKETS), band_rows(percent)
    bands = regs[:, : BUCKETS // per * per].reshape(len(ids), -1, per)
    left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
    out = []
    for k in left:
        other = right[(parts[right] != parts[k]) & ((ids[right] > ids[k]) if i == j else True)]
        other = other[(100 * np.minimum(n[k], n[other]) >= percent * np.maximum(n[k], n[other]))]
        other = other[may_link(_equal(regs[k][None, :], regs[other]), np.full(len(other), n[k]), n[other], percent)] if len(other) else other
        if len(other):
            other = other[(bands[k][None] == bands[other]).all(-1).argmax(1) == band]
        if len(other):
            out.append((k, other))
    return out


def _joined(rows: pa.Table, size: int, percent: int) -> list[tuple[int, int]]:
    """The links between a pair of blocks, as whole sets tell them, that are needed to join its components: fewer than it has rows."""
    open_ = _open(rows, percent)
    if not open_:
        return []
    ids, parts = np.asarray(rows.column("id")), np.asarray(rows.column("part"))
    used = np.unique(np.concatenate([np.r_[k, o] for k, o in open_]))
    sets = dict(zip(used.tolist(), shingle_sets(rows.column("t").combine_chunks().take(pa.array(used)), size), strict=True))
    # Shingles numbered within the blocks: a set is marked once and met with all others by one gather and sum.
    names, number = np.unique(np.concatenate(list(sets.values())), return_inverse=True)
    sizes = np.array([len(x) for x in sets.values()])
    ends = np.cumsum(sizes)
    spans = {k: (e - s, e) for k, s, e in zip(sets, sizes, ends, strict=True)}
    mark, root, out = np.zeros(len(names), bool), {int(x): int(x) for x in np.unique(parts)}, []

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for k, other in open_:
        a, b = spans[k]
        mark[number[a:b]] = True
        other = [o for o in other.tolist() if find(int(parts[o])) != find(int(parts[k]))]
        if other:
            at = np.concatenate([number[spans[o][0] : spans[o][1]] for o in other])
            lengths = np.array([len(sets[o]) for o in other])
            both = np.add.reduceat(mark[at].astype(np.int64), np.cumsum(lengths) - lengths)
            for o in np.flatnonzero(100 * both >= percent * (len(sets[k]) + lengths - both)):
                x, y = find(int(parts[k])), find(int(parts[other[o]]))
                if x != y:
                    root[max(x, y)] = min(x, y)
                    out.append((int(ids[k]), int(ids[other[o]])))
        mark[number[a:b]] = False
    return out


def crossing(members: DataFrame, reps: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """a, b: links between sets of one bucket that are not yet of one component. ``members``: band, key, id, part, size.

    A bucket is dealt into blocks; each pair of blocks is one group, so a large bucket is many groups. A bucket of S sets
    has S / BLOCK blocks, and so sends S * S / BLOCK rows: that is quadratic, if by a small factor, and these rows hold
    sketches alone. Texts are then sent only to the pairs of blocks, and for the sets, that the sketches leave open. There whole sets are
    compared at once; of the links only those that join components leave, fewer than the blocks have rows.
    """
    rows = members.withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int")).withColumn("own", F.pmod(F.xxhash64("id", F.lit(3)), F.col("blocks")).cast("int"))
    pair = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.least(k, F.col("own")).alias("i"), F.greatest(k, F.col("own")).alias("j")))
    by, sketched = ["band", "key", "i", "j"], reps.select("id", "n", "regs")
    units = rows.join(sketched, "id").select("band", "key", "id", "part", "own", "n", "regs", F.inline(pair))

    def involved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches, by):
            if found := _open(table, percent):
                used = np.unique(np.concatenate([np.r_[k, o] for k, o in found]))
                yield from table.select([*by, "id", "part", "own"]).take(pa.array(used)).combine_chunks().to_batches()

    kind = "band int, key long, i int, j int, id long, part long, own int"
    used = cut(dealt(units, *by).select(*by, "id", "part", "own", "n", "regs").mapInArrow(involved, kind), "involved")
    wanted = used.join(sketched, "id").join(texts_of(used.select("id"), docs), "id").select(*by, "id", "part", "own", "n", "regs", "t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches, by):
            if found := _joined(table, size, percent):
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], names=["a", "b"])

    return dealt(wanted, *by).mapInArrow(run, "a long, b long").distinct()


def _chosen(members: DataFrame, lead: str, part: DataFrame | None) -> DataFrame:
    """a, b: each set with the leader of the buckets that it shares most often, of those in other components."""
    votes = members.filter(F.col("id") != F.col(lead)).groupBy("id", F.col(lead).alias("l")).agg(F.count("*").alias("c"))
    if part is not None:
        of = lambda c, name: part.select(F.col("id").alias(c), F.col("component").alias(name))
        votes = votes.join(of("id", "p"), "id", "left").join(of("l", "q"), "l", "left").filter(F.coalesce("p", "id") != F.coalesce("q", "l"))
    best = votes.groupBy("id").agg(F.max(F.struct("c", (-F.col("l")).alias("m"))).alias("x"))
    return best.select(F.col("id").alias("a"), (-F.col("x.m")).alias("b"))


def _merged(part: DataFrame | None, links: DataFrame) -> DataFrame:
    """id, component of the sets so far, after more links between them."""
    if part is None:
        return components(links).withColumnRenamed("node", "id")
    of = lambda c: part.select(F.col("id").alias(c), F.col("component").alias(f"p{c}"))
    between = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("pa", "a").alias("a"), F.coalesce("pb", "b").alias("b"))
    higher = components(between)
    old = part.join(higher.select(F.col("node").alias("component"), F.col("component").alias("top")), "component", "left").select("id", F.coalesce("top", "component").alias("component"))
    fresh = higher.select(F.col("node").alias("id"), "component").join(part.select("id"), "id", "left_anti")
    return cut(old.unionByName(fresh), "parts")


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, n_shingles, component_id, kept.

    Sets of distinct shingles of ``size`` words with 100 * intersection >= percent * union are linked; a component
    is named after its smallest key and keeps that row. A text without words links with nothing. Rows of equal
    keys are taken as one document's; a row of a null key is on its own, component null, and kept. Other columns
    are left out; an empty table gives an empty table.

    Equal sets become one first. Bands of registers choose candidates: of eight at a threshold of 85 per cent (a pair
    there meets in one with probability 0.99996), of six at 80 (0.999997). Each set is tried with a leader of the buckets that
    it shares most often, twice; that joins most components. Then only the pairs of a bucket that still lie in different
    components are compared, in blocks.
    """
    rows = cut(sketches(docs, size, key, text), "sketches")
    sets = rows.filter("n > 0 and id is not null").groupBy("n", "d1", "d2").agg(F.min("id").alias("id"), F.first("regs").alias("regs"))
    reps = cut(sets, "sets")
    texts = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("t"))
    bands = band_keys(reps, band_rows(percent))
    shared = bands.groupBy("band", "key").agg(F.min("id").alias("lead"), F.min_by("id", F.xxhash64("id")).alias("lead2"), F.count("*").alias("size")).filter("size > 1")
    members = cut(bands.join(shared, ["band", "key"]), "members")
    part = None
    for lead in ("lead", "lead2"):
        links = cut(confirmed(cut(likely(_chosen(members, lead, part), reps, percent), "pairs"), texts, size, percent), "confirmed")
        part = _merged(part, links)
    parted = members.join(part, "id", "left").select("band", "key", "id", F.coalesce("component", "id").alias("part"))
    open_keys = parted.groupBy("band", "key").agg(F.min("part").alias("p0"), F.max("part").alias("p1"), F.count("*").alias("size")).filter("p0 <> p1").select("band", "key", "size")
    rest = cut(parted.join(open_keys, ["band", "key"]), "open")
    part = _merged(part, cut(crossing(rest, reps, texts, size, percent), "crossing"))
    named = reps.select("n", "d1", "d2", "id").join(part, "id", "left").select("n", "d1", "d2", F.coalesce("component", "id").alias("component"))
    linked = rows.filter("n > 0 and id is not null").select("id", "n", "d1", "d2").join(named, ["n", "d1", "d2"]).select("id", "n", "component")
    alone = rows.filter("n = 0 or id is null").select("id", "n", F.col("id").alias("component"))
    return linked.unionByName(alone).select(F.col("id").alias(key), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.coalesce(F.col("id") == F.col("component"), F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, size: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay: one key of each component."""
    kept = near_duplicates(docs, size, percent, key, text).filter("kept").select(F.col(key).alias("__k")).distinct()
    return docs.join(kept, F.col(key).eqNullSafe(F.col("__k")), "left_semi")
