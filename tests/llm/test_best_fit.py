"""Best-fit packing: against the library's ids, plain best fit over single pieces, and the whole tables."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from curbflow.llm import queries
from curbflow.llm.best_fit import ByteEncoder, best_fit_packed, planned

PATH = queries.tokenizer("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def test_encoder_equals_the_library(library):
    rng = random.Random(1)
    parts = [" ", " ", "\n", "\t", "\r", "a", "the", "I'm", "é", "ß", "1", "23", ".", "!!", "<|endoftext|>", " ", "\xa0"]
    parts += ["日本", "\x1c", "\x85", "'s", "<|", "\x0b", "🙂", "́"]
    texts = ["".join(rng.choices(parts, k=rng.randrange(15))) for _ in range(8000)]
    got = ByteEncoder(PATH).encode([*texts, None, ""])
    assert [np.frombuffer(g, "<u4").tolist() for g in got[:-2]] == [
        library.encode(t, add_special_tokens=False).ids for t in texts
    ]
    assert got[-2:] == [b"", b""]


def plain_best_fit(counts, window):
    rooms = []
    for length in sorted(counts, reverse=True):
        for _ in range(counts[length]):
            fitting = [(r, i) for i, r in enumerate(rooms) if r >= length]
            if fitting:
                rooms[min(fitting)[1]] -= length
            else:
                rooms.append(window - length)
    return Counter(rooms)


@pytest.mark.parametrize("seed", range(12))
def test_plan_equals_best_fit_of_single_pieces(seed):
    rng = random.Random(seed)
    window = rng.choice([7, 32, 100])
    counts = {n: rng.randrange(30) for n in rng.sample(range(1, window + 1), rng.randrange(1, window))}
    filled, offsets, ranks = Counter(), {}, Counter()
    for length, first, n, sequence, each, at in planned(counts, window):
        assert first == ranks[length] and n % each == 0
        ranks[length] += n
        for i in range(n):
            filled[sequence + i // each] += length
            offsets.setdefault(sequence + i // each, []).append((at + i % each * length, length))
    assert ranks == Counter(counts)
    assert Counter(window - x for x in filled.values()) == plain_best_fit(counts, window)
    for pieces in offsets.values():
        end = 0
        for at, length in sorted(pieces):
            assert at == end
            end += length


def test_plan_does_not_grow_with_the_counts():
    rng = random.Random(0)
    counts = {n: rng.randrange(1, 50) for n in range(1, 1025)}
    assert len(planned({n: c * 10**9 for n, c in counts.items()}, 1024)) < 8 * 1024
    assert planned({}, 1024) == [] and planned({5: 0}, 1024) == []


def check(out, rows, library, window):
    wanted = [np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4") for _, t in rows]
    by_doc: dict = {}
    for r in out:
        by_doc.setdefault(r["doc_id"], []).append(r)
    whole = Counter()
    for doc_id, pieces in by_doc.items():
        left = sorted(pieces, key=lambda r: (r["piece"], bytes(r["ids"])))
        assert all(r["length"] * 4 == len(r["ids"]) for r in left)
        if doc_id is not None and len({r["piece"] for r in left}) == len(left):
            assert [r["piece"] for r in left] == list(range(len(left)))
            assert all(r["length"] == window for r in left[1:])
            assert [r["start"] for r in left] == np.r_[0, np.cumsum([r["length"] for r in left])][:-1].tolist()
            whole[doc_id, b"".join(bytes(r["ids"]) for r in left)] += 1
    known = Counter(i for i, _ in rows)
    assert whole == Counter((i, w.tobytes()) for (i, _), w in zip(rows, wanted, strict=True) if i is not None and known[i] == 1)
    assert sum(r["length"] for r in out) == sum(map(len, wanted))
    sequences: dict = {}
    for r in out:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in sequences.values():
        end = 0
        for at, length in sorted(pieces):
            assert at == end
            end += length
        assert end <= window
    return len(sequences)


def test_packed_documents(spark, library):
    rng = random.Random(4)
    words = ["stone", "river", "Light", "wind.", "çava", "straße", "\n", "x1"]
    rows = [(i, " ".join(rng.choices(words, k=rng.randrange(60)))) for i in range(80)]
    rows += [(90, None), (91, ""), (92, "   \n\n\n "), (None, "one two"), (None, None), (7, "again"), (7, "again")]
    rows += [(93, " ".join(rng.choices(words, k=20_000))), (94, "a" * 70)]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, length int, ids string").repartition(5)
    out = best_fit_packed(docs, PATH, window=64)
    assert out.columns == ["doc_id", "piece", "start", "length", "sequence_id", "offset", "ids"]
    got = out.collect()
    n = check(got, rows, library, 64)
    assert n <= -(-sum(r["length"] for r in got) // 64) + 1
    assert sum(r["doc_id"] is None for r in got) == 2
    empty = best_fit_packed(docs.where("false"), PATH)
    assert empty.collect() == [] and empty.columns == out.columns


def test_ranks_run_over_all_shards(spark):
    """A third of all rows of one length, in many shards: no slot is taken twice."""
    docs = spark.range(6000).select("id", F.when(F.col("id") % 3 == 0, "a").otherwise(F.repeat(F.lit("b "), (F.col("id") % 50).cast("int"))).alias("text"))
    out = best_fit_packed(docs.repartition(13), PATH, window=128, id_col="id", carry={"crc": F.crc32("ids")})
    rows = out.collect()
    assert len(rows) == 6000 == len({(r["sequence_id"], r["offset"]) for r in rows})
    room = Counter()
    for r in rows:
        room[r["sequence_id"]] += r["length"]
    assert max(room.values()) <= 128 and len(room) == -(-sum(room.values()) // 128)


def test_query_on_whole_documents(spark, library):
    sf = "/root/testdata/sf0.01"
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.op11_best_fit_packing(spark, sf).collect()
    ids = {i: [*library.encode(t or "", add_special_tokens=False).ids, 2] for i, t in docs.items()}
    for r in rows:
        mine = np.array(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]], "<u4")
        assert zlib.crc32(mine.tobytes()) == r["ids_crc32"]
    assert sum(r["length"] for r in rows) == sum(map(len, ids.values()))
    assert len({r["sequence_id"] for r in rows}) <= 1.005 * -(-sum(map(len, ids.values())) // 1024)
