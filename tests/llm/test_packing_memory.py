"""What a task of packing takes beside its shard, and that the steps which bound it change nothing."""

import random
import tracemalloc
from types import SimpleNamespace

import numpy as np
import pyarrow as pa

from curbflow.llm import packing, queries

PATH = queries.tokenizer("word_bpe_49k.json")


def texts(n, length, words=20_000, seed=2):
    rng = random.Random(seed)
    known = ["".join(rng.choices("etaoinshrdlu", k=rng.randrange(2, 9))) for _ in range(words)]
    return [" ".join(rng.choices(known, k=length)) for _ in range(n)]


def test_memory_of_a_task(spark, monkeypatch):
    """A shard of 970 000 tokens, which are 3.9 MB of ids."""
    monkeypatch.setattr(packing, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    df = spark.createDataFrame([], "doc_id long, text string")
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, run, schema: run)
    run = packing.packed(df, PATH)
    made = texts(400, 1000)
    batch = pa.RecordBatch.from_arrays([pa.array(range(400), pa.int64()), pa.array(made)], names=["doc_id", "__text"])
    packing.encoder(PATH)
    del made
    tracemalloc.start()
    try:
        sizes = [(out.num_rows, out.nbytes, sum(out.column("length").to_pylist())) for out in run(iter([batch]))]
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    ids = 4 * sum(n for *_, n in sizes)
    assert sum(n for n, *_ in sizes) >= 400 and ids > 3e6
    assert max(b for _, b, _ in sizes) < 1.5e6
    assert peak < 32e6


def test_index_counts_in_steps(monkeypatch):
    """A document longer than a step, empty steps' ends, and one step for all give the same index."""
    rng = np.random.default_rng(6)
    docs = [rng.integers(0, 90, n).astype(np.uint32) for n in (1, 300, 2, 7, 40, 1, 1, 64, 63, 65, 5)]
    whole = vars(packing.ShardIndex(docs))
    for step in (1, 64, 100):
        monkeypatch.setattr(packing, "COUNT_TOKENS", step)
        got = vars(packing.ShardIndex(docs))
        assert all(np.array_equal(whole[k], got[k]) for k in whole)


def test_steps_change_no_piece(spark, monkeypatch):
    made = [(i, t) for i, t in enumerate(texts(60, 70, words=300) + ["", "it's a 3rd <|x|> İé word", None, "one"])]
    df = spark.createDataFrame(made, "doc_id long, text string").coalesce(1)
    whole = packing.packed(df, PATH, window=256).collect()
    monkeypatch.setattr(packing, "TEXT_BYTES", 100)
    monkeypatch.setattr(packing, "OUT_BYTES", 500)
    assert packing.packed(df, PATH, window=256).collect() == whole
