"""The prefix trie against a plain trie of tuples, with deep and shared conversations, small fragments and shards."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from curbflow.llm import prefix_trie as pt
from curbflow.llm.prefix_trie import PerfectHash, prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, depth int, h1 string"


def kept(c):
    return zlib.crc32(str(c).encode()) % 9


def plain(rows):
    convs = {}
    for c, turn, role, text, *_ in rows:
        if c is not None:
            convs.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    convs = {c: [t[2:] for t in sorted(turns)] for c, turns in convs.items()}
    built = {c: tuple(convs.get(c - int(np.fmod(c, 5)), [])[: kept(c)] + own[kept(c) :]) for c, own in convs.items()}
    nodes, ends = {}, {}
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(turns[:d], []).append(c)
        ends.setdefault(turns, []).append(c)
    children = {n: 0 for n in nodes}
    leaves, saved = dict(children), dict(children)
    for n, members in nodes.items():
        if n:
            children[n[:-1]] += 1
        own = (len(members) - 1) * len(n[-1][1].encode()) if n else 0
        for d in range(len(n) + 1):
            saved[n[:d]] += own
    for n in nodes:
        if not children[n]:
            for d in range(len(n) + 1):
                leaves[n[:d]] += 1
    out = []
    for n, members in nodes.items():
        ids = ",".join(map(str, sorted(ends.get(n, []))))
        parent = min(nodes[n[:-1]]) if n else None
        out.append((min(members), len(n), parent, len(members), children[n], leaves[n], saved[n], hashlib.sha256(ids.encode()).hexdigest()))
    return sorted(out, key=repr)


def got(spark, rows, parts=5):
    df = spark.createDataFrame(rows, SCHEMA).repartition(parts)
    keep = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(9))
    out = prefix_trie(df, 8, F.col("conv_id") - F.col("conv_id") % 5, keep)
    assert out.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted((tuple(r) for r in out.collect()), key=repr)


def some_rows(seed):
    rng = random.Random(seed)
    texts = ["a", "b", "", None, "çava ß", "日本", "a\x00", "x" * 5000]
    rows = []
    for c in [*range(-7, 60), *range(100, 140, 3)]:
        for t in range(rng.randrange(1, 9)):
            rows.append((c, t, rng.choice(["user", "user", "assistant", None]), rng.choice(texts[: 3 if c % 2 else 8]), 1, "x"))
    shared = [(t, "user", rng.choice(texts)) for t in range(12)]
    for c in range(200, 260):  # copies of one conversation, and some that leave it
        rows += [(c, t, r, x if c % 9 or t < 10 else str(c), 1, "x") for t, r, x in shared[: 12 - c % 4]]
    rows += [(300 + c, t, "user", f"deep {t}" if t < 70 else f"{c} {t}", 1, "x") for c in (0, 1, 5) for t in range(90)]
    rows += [(7, None, "user", "no turn", 1, "x"), (7, 2, "user", "tie", 1, "x"), (7, 2, "user", "tie", 1, "x"), (7, 2, "assistant", "tie", 1, "x")]
    rows += [(None, 0, "user", "nobody", 1, "x"), (400, 0, "system", "alone", 1, "x"), (10**15 + 3, 0, None, None, 1, "x")]
    return rows


@pytest.mark.parametrize("small", (False, True))
def test_against_a_plain_trie(spark, monkeypatch, small):
    if small:
        for name, value in (("MEMBERS", 3), ("CROWN", 10**6), ("SHARD_RUNS", 20)):
            monkeypatch.setattr(pt, name, value)
    rows = some_rows(2)
    assert got(spark, rows) == plain(rows)


def test_one_conversation_over_many_partitions(spark):
    rng = random.Random(8)
    rows = [(5, t, "user", rng.choice("ab"), 1, "x") for t in range(250)]
    rows += [(5 + c, t, "user", rows[t][3] if t != 200 else "c", 1, "x") for c in (1, 2) for t in range(250)]
    rows += [(c, 0, "user", "a", 1, "x") for c in range(20, 200)]
    aqe = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        assert got(spark, rows) == plain(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", aqe)


def test_nothing(spark):
    assert got(spark, []) == []
    assert got(spark, [(None, 1, "user", "x", 1, "x")]) == []


def test_perfect_hash_is_minimal_and_finds_only_its_keys():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 5000):
        high, low = rng.integers(0, 2**63, n).astype(np.uint64), rng.integers(0, 3, n).astype(np.uint64)
        table = PerfectHash(high, low)
        assert sorted(table.slots) == list(range(n)) and (table.find(high, low) == table.slots).all()
        assert (table.find(high, low + np.uint64(7)) == -1).all()
    with pytest.raises(ValueError):
        PerfectHash(np.array([4, 4], np.uint64), np.array([1, 1], np.uint64))


def test_one_digest_for_two_prefixes_is_an_error(spark):
    """Nodes whose members disagree on what their last turn is don't pass."""
    paths = spark.createDataFrame([(1, 1, 9, 9, 0, 0, 3, 3, "x", True), (2, 1, 9, 9, 0, 0, 3, 3, "y", True)], pt.PATH)
    convs = spark.createDataFrame([(1, 1), (2, 1)], "conv_id long, n_turns long")
    with pytest.raises(Exception, match="two prefixes have one digest"):
        pt.trie_nodes(paths, convs).collect()
