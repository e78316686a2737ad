"""Repeated rows, clashing names, ties, very long texts, and inputs that need more than one shard or automaton."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from curbflow.llm import decontaminate, packing, queries
from curbflow.llm.decontaminate import contamination
from curbflow.llm.hidden_markov import hidden_markov_scores
from curbflow.llm.language_id import language_id, train_language_id
from curbflow.llm.packing import packed
from curbflow.llm.secrets import redact_secrets, scan, secret_spans

WORDS = ["stone", "river", "wind", "market", "night", "straße", "lamp", "seven"]


def text(rng, n):
    return " ".join(rng.choices(WORDS, k=n))


def test_hidden_markov_with_clashing_names_and_repeated_rows(spark):
    """Columns named like the results don't matter; a repeated row counts and is scored as often as it comes."""
    rng = random.Random(5)
    made = [(i, text(rng, 12)) for i in range(30)] + [(3, "stone wind")] * 4 + [(None, None)]
    plain = spark.createDataFrame(made, "doc_id long, text string").withColumn("doc_id", F.coalesce("doc_id", F.lit(99)))
    clash = plain.withColumns({c: F.lit("x") for c in ("score", "n_tokens", "base_score", "word", "state", "shard", "n")})
    held = F.col("doc_id") % 7 == 2
    got = [
        sorted((r["doc_id"], r["n_tokens"], round(r["base_score"], 9), round(r["score"], 6)) for r in hidden_markov_scores(d, held, states=2).collect())
        for d in (plain, clash)
    ]
    assert got[0] == got[1] and len(got[0]) == len(made)
    assert len({r for r in got[0] if r[:2] == (3, 3)}) == 1 and sum(r[:2] == (3, 3) for r in got[0]) == 4


def test_language_of_ties_long_texts_and_an_empty_name(spark):
    """An empty string is a language like others; equal training texts tie, and the first name wins."""
    rng = random.Random(6)
    some = [text(rng, 30) for _ in range(20)]
    other = [" ".join(rng.choices(["çaré", "ouille", "éte"], k=30)) for _ in range(20)]
    made = [(t, k) for t in some for k in ("b", "a")] + [(t, "") for t in other] + [(None, "c"), ("", "d"), (some[0], None)]
    trees = train_language_id(spark.createDataFrame(made, "text string, lang string"))
    long = text(rng, 150_000)
    assert len(long) > 1 << 19
    asked = spark.createDataFrame([(0, some[0]), (1, other[0]), (2, long), (3, long), (4, "")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in language_id(asked.withColumn("lang_pred", F.lit(0)), trees).collect()}
    assert [got[i]["lang_pred"] for i in range(5)] == ["a", "", "a", "a", "und"]
    assert got[2]["score"] == got[3]["score"] and all(0 <= r["score"] <= 1 for r in got.values())


def test_secrets_of_repeated_and_very_long_texts(spark):
    rng = random.Random(7)
    part = ' password = "hunter2222" AKIA' + "A1" * 8 + " "
    long = part.join(text(rng, 20_000) for _ in range(6))
    df = spark.createDataFrame([(1, long), (1, long), (2, part), (2, part)], "doc_id long, text string").withColumn("kind", F.lit(3))
    got = [(r["doc_id"], tuple((x["kind"], x["start"], x["end"]) for x in r["secrets"])) for r in secret_spans(df).collect()]
    want = {i: tuple((x["kind"], x["start"], x["end"]) for x in scan(t, 200)) for i, t in ((1, long), (2, part))}
    assert Counter(got) == Counter({(i, w): 2 for i, w in want.items()})
    assert Counter(k for k, _, _ in want[1])["assign"] == 5 == Counter(k for k, _, _ in want[1])["access"]
    for _, a, b in want[1]:
        assert long[a:b] in part
    clean = redact_secrets(df)
    assert clean.columns == df.columns and not [r for r in clean.collect() if "hunter" in r["text"] or "AKIA" in r["text"]]


def test_packing_in_several_shards(spark, monkeypatch):
    """Shards end where their room does; repeated and null ids are documents of their own, and only shards' ends are padded."""
    from tokenizers import Tokenizer

    monkeypatch.setattr(packing, "SHARD_TOKENS", 3000)
    path = queries.tokenizer("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    rng = random.Random(8)
    made = [(i % 50, text(rng, rng.randrange(80))) for i in range(200)] + [(None, text(rng, 9)), (None, None), (7, text(rng, 9000))]
    df = spark.createDataFrame(made, "doc_id long, text string").coalesce(2).withColumns({c: F.lit("x") for c in ("start", "length", "ids", "__ids")})
    window = 512
    pieces = packed(df, path, window=window).collect()
    want = Counter()
    for _, t in made:
        want.update([*library.encode(t or "", add_special_tokens=False).ids, 2])
    got, ends = Counter(), {}
    for p in sorted(pieces, key=lambda p: (p["sequence_id"], p["offset"])):
        ids = np.frombuffer(p["ids"], "<u4")
        assert len(ids) == p["length"] and p["offset"] == ends.get(p["sequence_id"], 0)
        ends[p["sequence_id"]] = p["offset"] + p["length"]
        got.update(ids.tolist())
    assert got == want
    whole = Counter((p["doc_id"], p["doc_tokens"]) for p in pieces if p["start"] == 0)
    assert whole == Counter((i, len(library.encode(t or "", add_special_tokens=False).ids) + 1) for i, t in made)
    short = [n for n in ends.values() if n < window]
    shards = sum(want.values()) // 3000 + 4
    assert len(ends) > sum(want.values()) // 3000 and all(n & (n - 1) == 0 for n in short)
    assert len(short) <= shards * (window.bit_length() - 1)


@pytest.mark.parametrize("room", [2 << 20, 60])
def test_contamination_with_one_and_many_automata(spark, monkeypatch, room):
    """Any number of automata finds the same, in very long texts too; old columns of the results' names go."""
    monkeypatch.setattr(decontaminate, "GROUP_BYTES", room)
    rng = random.Random(9)
    passages = [" ".join(f"p{k}w{i}" for i in range(14)) for k in range(6)]
    items = [(f"i{k}", p) for k, p in enumerate(passages)] + [("i0", passages[0]), ("j0", passages[0]), ("short", "only four words here")]
    benchmark = spark.createDataFrame(items, "item_id string, text string").withColumn("contaminated", F.lit(1))
    long = " ".join([text(rng, 60_000), passages[1].upper(), text(rng, 60_000), *passages[2].split()[:9], "stone", *passages[3].split()[4:]])
    made = [(0, long), (0, long), (1, passages[0]), (2, text(rng, 30)), (3, "so, only FOUR words here."), (4, "only four words"), (5, None), (6, "")]
    df = spark.createDataFrame(made, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("n_hit", "contaminated", "hit_items", "item_id")})
    got = Counter((r["doc_id"], r["n_hit"], tuple(r["hit_items"])) for r in contamination(df, benchmark).collect())
    assert got == Counter(
        [(0, 24, ("i1", "i3"))] * 2 + [(1, 14, ("i0", "j0")), (2, 0, ()), (3, 4, ("short",)), (4, 0, ()), (5, 0, ()), (6, 0, ())]
    )
    assert contamination(df, benchmark).first()["item_id"] == "x"
