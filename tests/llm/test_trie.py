"""The conversation prefix trie against one that is built turn by turn."""

import hashlib
import random
import zlib

import pytest

from askmill.llm import trie
from tests.oracle import SMALL

TURNS = "conv_id long, turn long, role string, text string"


def brute_force(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(xs, key=lambda x: x[:2])] for c, xs in own.items()}
    full = {}
    for c, xs in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        full[c] = own.get(c - c % 5, [])[:h] + xs[h:]
    members, children = {}, {}
    for c, xs in full.items():
        for d in range(len(xs) + 1):
            members.setdefault(tuple(xs[:d]), []).append(c)
            if d:
                children.setdefault(tuple(xs[: d - 1]), set()).add(tuple(xs[:d]))
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        below = children.get(node, ())
        leaves[node] = sum(leaves[x] for x in below) if below else 1
        saved[node] = sum(saved[x] for x in below) + (len(members[node]) - 1) * (len(node[-1][1].encode()) if node else 0)
    out = []
    for node, cs in members.items():
        ends = ",".join(map(str, sorted(c for c in cs if len(full[c]) == len(node))))
        out.append((min(cs), len(node), min(members[node[:-1]]) if node else None, len(cs), len(children.get(node, ())), leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def found(df):
    assert df.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted((tuple(r) for r in df.collect()), key=str)


def invented(seed, n=60):
    """Few texts, so that many prefixes are shared; null and odd turns; groups of copies; ids with gaps."""
    rng, rows = random.Random(seed), []
    for c in rng.sample(range(3 * n), n):
        copied = rng.choice([None, None, 7, 8])
        own = random.Random(copied if copied is not None else rng.random())
        turns = rng.sample([None, *range(30)], own.choice([1, 3, 9, 14])) if copied is None else range(own.choice([2, 12]))
        rows += [(c, t, own.choice(["user", "assistant", None]), own.choice(["a", "é", "", None, "long " * 9])) for t in turns]
    return rows


@pytest.mark.parametrize("primes", [trie.PRIMES, (5, 7)])
def test_trie_against_brute_force(spark, primes, monkeypatch):
    """Tiny primes make most fingerprints collide: all of these must be split."""
    monkeypatch.setattr(trie, "BLOCK", 4)
    monkeypatch.setattr(trie, "ENDS", 3)
    rows = invented(5, 40 if primes[0] < 10 else 80)
    df = spark.createDataFrame([*rows, (None, 1, "user", "x")], TURNS).repartition(5)
    assert found(trie.prefix_trie(df, primes)) == brute_force(rows)


def test_given_conversations(spark):
    df = spark.read.parquet(f"{SMALL}/conversations.parquet")
    assert found(trie.prefix_trie(df)) == brute_force([tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()])


def test_one_long_conversation_and_many_copies(spark):
    """A conversation of a third of the rows, and one whose copies are another third."""
    rows = [(10, k, "user", str(k % 3)) for k in range(1500)] + [(100 + 5 * k, t, "user", "same") for k in range(500) for t in range(3)] + [(11, k, "user", str(k % 3)) for k in range(1500)]
    assert found(trie.prefix_trie(spark.createDataFrame(rows, TURNS))) == brute_force(rows)


def test_empty_and_repeated(spark):
    assert found(trie.prefix_trie(spark.createDataFrame([], TURNS))) == []
    assert found(trie.prefix_trie(spark.createDataFrame([(None, 1, "user", "x")], TURNS))) == []
    rows = [(3, 1, "user", "x")] * 12 + [(1, None, None, None), (-4, 2, "user", "y")]
    got = found(trie.prefix_trie(spark.createDataFrame(rows, TURNS).selectExpr("*", "1 as n_convs", "'x' as f", "2 as depth")))
    assert got == brute_force([(c, t, r, x) for c, t, r, x in rows if c != -4] + [(-4, 2, "user", "y")])
