"""The corpus operators on small tables with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import hashlib
import math
import operator
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from curbflow.llm import queries
from curbflow.llm.components import connected_components
from curbflow.llm.decontaminate import contamination
from curbflow.llm.hidden_markov import hidden_markov_scores
from curbflow.llm import inner_products
from curbflow.llm.inner_products import top_products
from curbflow.llm.language_id import language_id, train_language_id
from curbflow.llm.near_duplicates import near_duplicates
from curbflow.llm.packing import B, K1, ShardIndex, pack, packed
from curbflow.llm.repeats import suffix_order, without_repeats
from curbflow.llm.secrets import redact_secrets, secret_spans
from curbflow.llm.token_counts import count_texts, token_counts
from curbflow.llm.toxicity import BUCKETS, ToxicityModel, fit, labelled_texts, score_toxicity, train_toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = ["the", "of", "stone", "river", "Light", "wind.", "market", "çava", "straße", "x1", "--", "night"]


def text(rng, n):
    return " ".join(rng.choices(WORDS, k=n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    base = text(rng, 120)
    some = [(i, text(rng, rng.randrange(1, 90)), "en", "s0", 1) for i in range(40)]
    some += [(40, base, "en", "s0", 1), (41, base, "en", "s0", 1), (42, base + " tail", "en", "s1", 1)]
    some += [(43, None, None, None, None), (44, "", "en", "s0", 0), (45, "   ", "de", "s0", 3), (46, "one two", "en", "s0", 1)]
    some += [(47, "one two", "en", "s0", 1), (48, text(rng, 30_000), "en", "s0", 1), (46, "one two", "en", "s0", 1)]
    some += [(None, base, "en", "s0", 1)]
    return some


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def words(t):
    return (t or "").encode().lower().split()


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(50, 51), (7, 7), (51, 52)], "a long, b long")
    got = {r["node"]: r["label"] for r in connected_components(edges).collect()}
    assert got == {i: 0 for i in range(31)} | {50: 50, 51: 50, 52: 50}


def test_token_counts(docs, rows, empty):
    from tokenizers import Tokenizer

    path = queries.tokenizer("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    got = token_counts(docs.withColumn("n_tokens", F.lit("old")), path).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["n_tokens"] == len(t.encode(r["text"] or "", add_special_tokens=False).ids)
        assert r["n_bytes"] == len((r["text"] or "").encode()) and r["over_limit"] == (r["n_tokens"] > 1024)
    assert token_counts(empty, path).count() == 0
    rng = random.Random(1)
    marks = [*"abc  \n\t'stre01.,é中\x1c\x85​\xa0😀|<>", "<|endoftext|>", "'re", "aaaa", "the ", "  "]
    odd = ["".join(rng.choices(marks, k=rng.randrange(40))) for _ in range(500)] + ["a" * 999, "\n" * 50, " "]
    assert count_texts(odd, path) == [len(t.encode(x, add_special_tokens=False).ids) for x in odd]


def test_secret_scan(spark, empty):
    key = "aB3" + "x9Z" * 12 + "q"
    cases = [
        ('password = "hunter2222" and AKIA' + "A1" * 8, {"assign", "access"}),
        ("api_key: " + "0f" * 16, {"assign", "hex"}),
        ("secret=token: abcdefg", set()),
        (f"user=jane\nkey {key} at https://h.example", {"linked_secret", "linked_identity", "linked_endpoint"}),
        (f"nothing but {key} here", set()),
        (f"user=jane\n\nkey {key}", set()),
        (None, set()),
        ("", set()),
    ]
    df = spark.createDataFrame([(i, t, 5) for i, (t, _) in enumerate(cases)], "doc_id long, text string, secrets int")
    got = {r["doc_id"]: r for r in secret_spans(df).collect()}
    for i, (t, kinds) in enumerate(cases):
        spans = got[i]["secrets"]
        assert {x["kind"] for x in spans} == kinds
        assert [x["start"] for x in spans] == sorted(x["start"] for x in spans)
    clean = {r["doc_id"]: r["text"] for r in redact_secrets(df).collect()}
    assert clean[2] == cases[2][0] and "hunter" not in clean[0] and clean[6] is None
    assert secret_spans(empty).count() == 0


def test_decontamination(spark, docs, empty):
    rng = random.Random(9)
    passage = [f"w{i}" for i in range(25)]
    benchmark = spark.createDataFrame(
        [(10, " ".join(passage)), (9, "Short Item, three"), (3, None), (4, ""), (None, "a b c"), (10, " ".join(passage))],
        "item_id long, text string",
    )
    cases = [
        "before " + " ".join(passage[5:18]).upper() + ", after",
        "x short! item\nthree y",
        " ".join(passage[:9]),
        text(rng, 50),
        "short item, three" * 2,
        None,
        "",
    ]
    df = spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in contamination(df, benchmark).collect()}
    assert (got[0]["n_words"], got[0]["n_hit"], got[0]["hit_items"]) == (15, 13, ["10"])
    begin, end = got[0]["hit_spans"][0]
    assert cases[0][begin:end] == " ".join(passage[5:18]).upper()
    assert (got[1]["n_hit"], got[1]["hit_items"]) == (3, ["9"])
    assert not got[2]["contaminated"] and not got[3]["contaminated"]
    assert got[4]["n_words"] == 5 and got[4]["n_hit"] == 0
    assert got[5]["n_words"] == got[6]["n_words"] == 0
    assert contamination(docs, benchmark.limit(0)).where("contaminated").count() == 0
    assert contamination(empty, benchmark).count() == 0


def brute_near(rows):
    """Component by row, from all pairs of shingle sets."""
    sets = []
    for _, t, *_ in rows:
        w = words(t)
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset())
    group = list(range(len(rows)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and rows[i][0] is not None and rows[j][0] is not None and 100 * len(a & b) >= 85 * len(a | b):
                group[root(i)] = root(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[root(i)] = min(least.get(root(i), r[0]), r[0])
    return Counter((r[0], len(sets[i]), least.get(root(i))) for i, r in enumerate(rows))


def test_near_duplicates(spark, docs, rows, empty):
    got = near_duplicates(docs.withColumn("node", F.lit(1))).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == brute_near(rows)
    assert all(r["kept"] == (r["doc_id"] is None or r["doc_id"] == r["component_id"]) for r in got)
    assert near_duplicates(empty).count() == 0


def test_near_duplicates_of_a_large_group(spark):
    rng = random.Random(5)
    base = [f"w{rng.randrange(10**6)}" for _ in range(150)]
    made = []
    for i in range(700):  # more than two blocks, near the threshold, and short sets
        w = list(base)
        for _ in range(rng.randrange(0, 5)):
            w[rng.randrange(len(w))] = f"v{rng.randrange(10**6)}"
        made.append((1000 + i, " ".join(w)))
    made += [(i, " ".join(f"s{i % 7}_{j}" for j in range(9 + i % 3))) for i in range(60)]
    got = near_duplicates(spark.createDataFrame(made, "doc_id long, text string")).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == brute_near(made)


def test_suffix_order():
    rng = random.Random(2)
    for case in range(40):
        n = rng.randrange(1, 300)
        raw = bytes(rng.choices(b"ab" if case % 2 else b"abcd\xff\x00", k=n)) if case % 5 else b"a" * n
        order = suffix_order(np.frombuffer(raw, np.uint8)).tolist()
        assert sorted(order) == list(range(n))
        assert [raw[i : i + 104] for i in order] == sorted(raw[i : i + 104] for i in range(n))


def test_repeats(spark, empty):
    rng = random.Random(8)

    def some(n):
        return "".join(rng.choices("abcdefgh é", k=n))

    a, b = some(400), some(150)
    made = [(5, a + b), (2, some(90) + b[:130]), (9, a), (7, a), (1, b[:99]), (3, "z" * 500), (4, None), (6, ""), (8, some(60) * 6)]
    made += [(None, a), (9, a)]
    df = spark.createDataFrame([(i, t, 1) for i, t in made], "doc_id long, text string, mark int")
    got = {r["doc_id"]: r for r in without_repeats(df).collect()}
    assert without_repeats(df).count() == len(made)
    seen = set()
    for i, t in sorted({x for x in made if x[0] is not None}):
        raw = (t or "").encode()
        hit = np.zeros(len(raw), bool)
        for s in range(len(raw) - 99):
            w = raw[s : s + 100]
            hit[s : s + 100] |= w in seen
            seen.add(w)
        assert got[i]["kept"] == np.frombuffer(raw, np.uint8)[~hit].tobytes(), i
        assert got[i]["n_bytes"] == len(raw)
        assert len(got[i]["removed"]) == int((np.diff(np.r_[0, hit.astype(np.int8)]) == 1).sum())
    assert got[None]["kept"] == a.encode()
    assert without_repeats(empty).count() == 0


def test_packing(docs, rows, empty):
    from tokenizers import Tokenizer

    path = queries.tokenizer("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    pieces = packed(docs, path, window=256).collect()
    want = Counter((r[0], tuple(t.encode(r[1] or "", add_special_tokens=False).ids) + (2,)) for r in rows)
    by_doc = {}
    for p in sorted(pieces, key=lambda p: (p["sequence_id"], p["offset"])):
        by_doc.setdefault(p["doc_id"], []).append((p["start"], np.frombuffer(p["ids"], "<u4"), p["doc_tokens"]))
        assert len(by_doc[p["doc_id"]][-1][1]) == p["length"]
    for (doc_id, ids), n in want.items():
        if n == 1 and sum(r[0] == doc_id for r in rows) == 1:
            parts = sorted(by_doc[doc_id], key=lambda x: x[0])
            assert tuple(np.concatenate([x[1] for x in parts]).tolist()) == ids and {x[2] for x in parts} == {len(ids)}
    sizes = Counter()
    for p in sorted(pieces, key=lambda p: (p["sequence_id"], p["offset"])):
        assert p["offset"] == sizes[p["sequence_id"]]
        sizes[p["sequence_id"]] += p["length"]
    assert sum(sizes.values()) == sum(n * len(ids) for (_, ids), n in want.items())
    assert all(n == 256 or n & (n - 1) == 0 for n in sizes.values())
    assert packed(empty, path).count() == 0


def test_packing_scores_all_terms():
    rng = np.random.default_rng(5)
    hot = np.arange(20)  # copies of one document are more than a third of the shard
    docs = [rng.integers(0, 60, rng.integers(5, 40)) if i % 5 < 3 else hot for i in range(60)]
    counts = [Counter(d.tolist()) for d in docs]
    held, mean = Counter(t for c in counts for t in c), np.mean([len(d) for d in docs])

    def score(seed, i):
        norm = K1 * (1 - B + B * len(docs[i]) / mean)
        return sum(math.log1p((60 - held[t] + 0.5) / (held[t] + 0.5)) * counts[i][t] * (K1 + 1) / (counts[i][t] + norm) for t in counts[seed] if t in counts[i])

    index = ShardIndex(docs)
    for unused in (np.arange(60), np.arange(10, 60), np.arange(0, 60, 3), np.arange(0, 60, 6)):
        for seed in (3, 4, 0, 7):
            want = np.array([score(seed, i) for i in unused])
            assert np.allclose(index.scores(seed, unused) / 2**28, want, atol=1e-6)
            order = sorted(range(len(unused)), key=lambda j, want=want: (-round(want[j], 6), j))
            assert index.neighbours(seed, unused).tolist() == unused[order].tolist()


def test_packing_puts_copies_together():
    hot = [np.arange(20)] * 6
    others = [np.arange(100 + 20 * i, 120 + 20 * i) for i in range(8)]
    docs = [d for pair in zip(others, hot, strict=False) for d in pair] + others[6:]
    of_seed = [sequence for sequence in pack(docs, 60) if sequence[0][0] % 2 and sequence[0][0] < 12]
    assert of_seed and all(i % 2 and i < 12 for i, _, _ in of_seed[0])


def test_hidden_markov(docs, rows, empty):
    held = F.coalesce(F.col("doc_id"), F.lit(0)) % 7 == 2
    got = hidden_markov_scores(docs, held, states=3, rounds=2).collect()
    train = Counter()
    for r in rows:
        if (r[0] or 0) % 7 != 2:
            train.update([*words(r[1]), b""])
    n, v = sum(train.values()), len(train)
    assert len(got) == len(rows)
    by_id = {r[0]: r[1] for r in rows}
    for r in got:
        tokens = [*words(by_id[r["doc_id"]]), b""]
        assert r["n_tokens"] == len(tokens) and r["n_known"] == sum(train[w] > 0 for w in tokens)
        assert r["train_tokens"] == n
        assert math.isclose(r["base_score"], sum(math.log10((train[w] + 1) / (n + v + 1)) for w in tokens), rel_tol=1e-9)
        assert math.isfinite(r["score"]) and r["score"] < 0
    assert hidden_markov_scores(empty, F.lit(False)).count() == 0
    nothing = hidden_markov_scores(docs, F.lit(True)).collect()
    assert all(r["score"] == r["base_score"] == 0 and r["n_known"] == 0 for r in nothing)


def test_hidden_markov_probabilities_add_up(spark):
    """Over all one-word texts of the known words and one unknown word, and the end, probabilities of two tokens sum to one."""
    vocabulary = ["red", "green", "blue", "sky"]
    made = [(i, " ".join(random.Random(i).choices(vocabulary, k=6))) for i in range(40)]
    tests = [(1000 + i, t) for i, t in enumerate(["", *vocabulary, "unheard"])]
    df = spark.createDataFrame(made + tests, "doc_id long, text string")
    got = {r["doc_id"]: r for r in hidden_markov_scores(df, F.col("doc_id") >= 1000, states=2).collect()}
    # P(first token is the end) plus, for each other first token, P(token, end) / P(end | it) is bounded by one
    assert sum(10 ** got[1000 + i]["score"] for i in range(6)) < 1
    assert got[1005]["n_known"] == 1


def test_language_id(spark, docs, empty):
    rng = random.Random(4)
    speak = {"aa": ["thlon", "thre", "wesh", "onth"], "bb": ["ñoca", "çaré", "ouille", "éte"], "cc": ["schru", "ächt", "ßung", "zwir"]}
    made = [(i, " ".join(rng.choices(speak[k], k=40)), k) for i in range(60) for k in [list(speak)[i % 3]]]
    df = spark.createDataFrame(made, "doc_id long, text string, lang string")
    trees = train_language_id(df.where("doc_id % 4 <> 2"))
    got = language_id(df.withColumn("score", F.lit(7)), trees).where("doc_id % 4 = 2").collect()
    assert all(r["lang_pred"] == r["lang"] and 0.5 < r["score"] <= 1 for r in got)
    odd = spark.createDataFrame([(0, None), (1, ""), (2, "12 --"), (3, "中")], "doc_id long, text string")
    assert [r["lang_pred"] == "und" for r in language_id(odd, trees).orderBy("doc_id").collect()] == [True, True, True, False]
    assert language_id(empty, trees).count() == 0
    assert train_language_id(df.limit(0)) is None
    assert {r["lang_pred"] for r in language_id(df, None).collect()} == {"und"}


def test_language_code_lengths_are_probabilities(spark):
    from curbflow.llm.language_id import build

    trees = build({"a": [b"abracadabra" * 30], "b": [b"bananas and cabanas " * 30]}, order=3, min_count=3)
    n = trees.child.shape[1]
    weight = np.ones(n)
    weight[-1] = 256 - (n - 1)
    total = (2.0 ** -trees.bits.reshape(-1, n, 2).astype(np.float64) * weight[None, :, None]).sum(1)
    assert np.allclose(total, 1, atol=1e-4)


def test_toxicity(spark, empty):
    rng = random.Random(6)
    bad = ["slimeball", "rotbrain", "vilefool"]
    made, labels = [], []
    for i in range(600):
        t = [f"{rng.choice(['ther', 'on', 'esh', 'ble'])}{rng.choice(['an', 'wh', 'ing'])}" for _ in range(rng.randrange(10, 60))]
        if i % 5 == 0:
            t[rng.randrange(len(t))] = rng.choice(bad)
            t[rng.randrange(len(t))] = rng.choice(bad)
        made.append((i, " ".join(t)))
        labels.append((i, 1, int(i % 5 == 0)))
    docs = spark.createDataFrame([*made, (900, None), (901, "")], "doc_id long, text string")
    known = spark.createDataFrame([*labels, (None, 1, 1), (3, 1, None)], "doc_id long, quality int, toxic int")
    model = train_toxicity(labelled_texts(docs, known.where("doc_id % 3 <> 1")))
    got = {r["doc_id"]: r["score"] for r in score_toxicity(docs, model).collect()}
    assert len(got) == 602 and all(0 <= s <= 1 for s in got.values())
    held = [i for i in range(600) if i % 3 == 1]
    right = sum((got[i] >= 0.7) == (i % 5 == 0) for i in held) / len(held)
    assert right > 0.97
    assert got[900] == got[901] < 0.3
    assert model.score(["on esh slimebal ther"])[0] > got[901]
    assert score_toxicity(empty, model).count() == 0
    assert fit([], []).score(["x", None]).tolist() == [0.0, 0.0]


def test_toxicity_at_every_offset():
    model = ToxicityModel(np.zeros(BUCKETS), 0.0, 1.0, 0.0, {"bad": 8.0, "worse": 4.0, "x": 0.0, "y": 0.0})
    assert {model.raw(["x y " * i + "x " * j + "bad worse bad worse" + " x y" * 10])[0] for i in range(9) for j in (0, 1)} == {3.0}
    assert model.raw(["bad " * 8])[0] == 8.0 and model.raw(["bad"])[0] == 1.0


def test_toxicity_of_held_out_offsets_and_repeats():
    rng = random.Random(8)
    bad = ["slimeball", "rotbrain", "vilefool"]

    def clean(n):
        return [f"{rng.choice(['ther', 'on', 'esh', 'ble'])}{rng.choice(['an', 'wh', 'ing'])}" for _ in range(n)]

    texts, labels = [], []
    for i in range(600):
        t, at = clean(rng.randrange(10, 60)), rng.randrange(10)
        if i % 3 == 0:
            t[at:at] = rng.choices(bad, k=4)
        texts.append(" ".join(t))
        labels.append(int(i % 3 == 0))
    model = fit(texts, labels)
    at_offsets = [" ".join([*clean(i), *rng.choices(bad, k=4), *clean(30 - i)]) for i in range(31)]
    assert (model.score(at_offsets) >= 0.7).all()
    assert (model.score([" ".join([w] * 8) for w in bad]) >= 0.7).all()
    assert (model.score([" ".join(clean(30)) for _ in range(40)]) < 0.7).mean() > 0.95


def test_language_id_trains_on_distinct_texts(spark):
    """A page repeated without end doesn't lower its language's share of the sample; few texts and few languages are kept."""
    rng = random.Random(4)
    letters = {"aa": "abcde ", "bb": "vwxyz "}
    rows = [("".join(rng.choices(letters[k], k=200)), k) for k in letters for _ in range(60)]
    many = rows + [(rows[0][0], "aa")] * 20_000 + [("q" * 10, "cc"), ("", "dd"), (None, "aa"), ("text", None)]
    df = spark.createDataFrame(many, "text string, lang string")
    trees = train_language_id(df, sample_bytes=8000, max_langs=2)
    assert trees.langs == ["aa", "bb"]
    plain = train_language_id(spark.createDataFrame(rows, "text string, lang string"), sample_bytes=8000)
    assert np.array_equal(trees.bits, plain.bits)
    tests_ = spark.createDataFrame([("".join(rng.choices(letters[k], k=40)), k) for k in letters for _ in range(20)], "text string, lang string")
    assert language_id(tests_, trees).where("lang_pred <> lang").count() == 0
    assert train_language_id(df.limit(0)) is None and train_language_id(df.where("lang = 'dd'")) is None


def test_top_products(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(300, 8)) * rng.uniform(0.1, 3, (300, 1))
    v[10:20] = v[5]
    made = [(i, [float(x) for x in row]) for i, row in enumerate(v)]
    made += [(300, None), (301, [float("nan")] * 8), (302, [1.0, None] + [0.0] * 6), (303, [float("inf")] * 8), (304, []), (305, [1.0, 2.0]), (None, [1.0] * 8)]
    df = spark.createDataFrame(made, "vec_id long, embedding array<float>").withColumn("rank", F.lit(1))
    got = top_products(df, F.col("vec_id") % 5 == 0).collect()
    q = np.floor(v.astype(np.float32).astype(np.float64) * 256).astype(np.int64)
    s = q @ q.T
    want = {}
    for i in range(0, 300, 5):
        order = sorted((j for j in range(300) if j != i), key=lambda j: (-s[i, j], j))[:5]
        want |= {(i, k + 1): (j, int(s[i, j])) for k, j in enumerate(order)}
    assert {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in got} == want
    assert top_products(df.limit(0), F.col("vec_id") % 5 == 0).count() == 0
    few = spark.createDataFrame([(0, [1.0]), (1, [-1.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in top_products(few, F.col("vec_id") == 0).collect()] == [(0, 1, 1, -65536)]


def test_top_products_of_many_groups_and_parts(spark, monkeypatch):
    """Several sizes, lengths from short to long, groups of queries and parts of rows: the same as all products."""
    for name, value in (("PILOT", 30), ("QUERIES", 8), ("PART", 40), ("BUCKET", 16)):
        monkeypatch.setattr(inner_products, name, value)
    rng = np.random.default_rng(9)
    rows = [(i, (rng.normal(size=5 if i % 7 else 3) * 10.0 ** rng.uniform(-2, 1)).tolist(), "other") for i in range(400)]
    rows += [(i, rows[i % 50][1], "copy") for i in range(400, 480)] + [(480, [0.0] * 5, "zero"), (485, [1e6] * 5, "beyond 53 bits"), (490, [1e6, -1e6, 1e6, 1e6, 1e6], "the same")]
    df = spark.createDataFrame(rows, "vec_id int, embedding array<double>, score string")
    got = top_products(df, F.col("vec_id") % 5 == 0, k=4).collect()
    floors = {i: [math.floor(256 * x) for x in v] for i, v, _ in rows}
    want = []
    for q in (i for i in floors if i % 5 == 0):
        others = [(-sum(map(operator.mul, floors[q], v)), i) for i, v in floors.items() if i != q and len(v) == len(floors[q])]
        want += [(q, r, i, -s) for r, (s, i) in enumerate(sorted(others)[:4], 1)]
    assert sorted(map(tuple, got)) == sorted(want)


def test_top_products_of_a_repeated_query_id(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(60, 4))
    v[0] *= 9
    made = [(i, row.tolist()) for i, row in enumerate(v)] + [(0, v[0].tolist())] * 9
    df = spark.createDataFrame(made, "vec_id long, embedding array<double>")
    q = np.floor(v * 256).astype(np.int64)
    s = q @ q[0]
    order = sorted(range(1, 60), key=lambda j: (-s[j], j))[:5]
    got = top_products(df, F.col("vec_id") == 0).collect()
    assert {r["rank"]: (r["vec_id"], r["score"]) for r in got} == {k + 1: (j, int(s[j])) for k, j in enumerate(order)}


def test_digest_of_no_items():
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0") and zlib.crc32(b"0") % 7 >= 0


def test_hidden_markov_scores_equal_a_plain_recursion(docs, rows, monkeypatch):
    from curbflow.llm import hidden_markov as hm

    monkeypatch.setattr(hm, "SHARD_TOKENS", 400)  # several shards in a task
    held = F.coalesce(F.col("doc_id"), F.lit(0)) % 7 == 2
    texts = docs.select("doc_id", "text", held.alias("held"))
    coded, model, vocabulary = hm.trained(texts, 3, 2, 50)
    got = Counter((r["doc_id"], round(r["score"], 6)) for r in hm.score_texts(coded, model, vocabulary).collect())
    train = Counter()
    for r in rows:
        if (r[0] or 0) % 7 != 2:
            train.update([*words(r[1]), b""])

    def emission(word):
        if not train[word]:
            return model.emit[hm.UNKNOWN]
        s = vocabulary.symbol(word)
        return model.emit[s] * (train[word] - hm.DISCOUNT) / vocabulary.symbol_mass[s]

    want = Counter()
    for doc_id, t, *_ in rows:
        state, total = model.start, 0.0
        for i, w in enumerate([*words(t), b""]):
            state = (state if i == 0 else state @ model.move) * emission(w)
            total += math.log10(state.sum())
            state = state / state.sum()
        want[doc_id, round(total, 6)] += 1
    assert got == want
    assert vocabulary.tokens == sum(train.values()) and vocabulary.types == len(train)


def test_hidden_markov_expected_counts_equal_plain_ones(monkeypatch):
    from curbflow.llm import hidden_markov as hm

    monkeypatch.setattr(hm, "CHUNK", 40)
    rng = np.random.default_rng(3)
    k, lens = 3, np.array([150, 1, 40, 97, 41])
    symbols = rng.integers(0, 6, lens.sum())
    emit = np.zeros((hm.UNKNOWN + 1, k))
    emit[:6] = rng.dirichlet(np.ones(6), k).T
    model = hm.HiddenMarkov(rng.dirichlet(np.ones(k)), rng.dirichlet(np.ones(k), k), emit)
    got = np.zeros((hm.UNKNOWN + 3 + k, k))
    hm.expected_counts(model, symbols, lens, got)
    want = np.zeros_like(got)
    at = 0
    for n in lens.tolist():
        s = symbols[at : at + n]
        at += n
        f, b = np.zeros((n, k)), np.ones((n, k))
        f[0] = model.start * emit[s[0]]
        for t in range(1, n):
            f[t] = f[t - 1] @ model.move * emit[s[t]]
        for t in range(n - 2, -1, -1):
            b[t] = model.move @ (emit[s[t + 1]] * b[t + 1])
        p = f[-1].sum()
        np.add.at(want, s, f * b / p)
        want[hm.UNKNOWN + 1 + k] += f[0] * b[0] / p
        for t in range(1, n):
            want[hm.UNKNOWN + 1 : hm.UNKNOWN + 1 + k] += model.move * np.outer(f[t - 1], emit[s[t]] * b[t]) / p
    assert np.allclose(got, want, atol=1e-6)


def test_near_duplicates_in_small_parts_and_blocks(spark, monkeypatch):
    """Buckets of several parts, clusters of several blocks with nodes outside the main component, broadcast keys."""
    from curbflow.llm import common
    from curbflow.llm import near_duplicates as nd

    for module, name, value in ((nd, "PART", 8), (nd, "BLOCK", 6), (nd, "HUBS", 2), (common, "HEAVY_FROM", 3), (common, "HEAVY_KEYS", 5)):
        monkeypatch.setattr(module, name, value)
    rng = random.Random(15)
    made = []
    for family in range(3):
        base = [f"f{family}w{i}" for i in range(100)]
        for i in range(60):
            w = list(base)
            for _ in range(rng.randrange(0, 4)):
                w[rng.randrange(len(w))] = f"v{rng.randrange(10**6)}"
            made.append((1000 * family + i, " ".join(w)))
    made += [(9000 + i, made[0][1]) for i in range(20)] + [(None, made[0][1]), (9100, None), (9101, "")]
    got = near_duplicates(spark.createDataFrame(made, "doc_id long, text string")).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == brute_near(made)


def test_repeats_in_small_blocks_and_salted_hashes(spark, monkeypatch):
    """Every path: suffix arrays over several hashes, windows of wide and of frequent hashes, texts beyond a chunk."""
    from curbflow.llm import repeats

    for name, value in (("NARROW", 3), ("SAMPLE", 1), ("HOT_FROM", 6), ("BLOCK", 2000), ("CHUNK", 300)):
        monkeypatch.setattr(repeats, name, value)
    rng = random.Random(18)
    line = "".join(rng.choices("abcdefgh ", k=130))
    made = [(i, "".join(rng.choices("abé ", k=rng.randrange(200))) + line * (i % 3) + "".join(rng.choices("ab ", k=rng.randrange(200)))) for i in range(60)]
    made += [(70, "ab" * 900), (71, line * 9), (5, made[6][1]), (5, made[5][1]), (72, made[7][1][:150])]
    df = spark.createDataFrame(made, "doc_id long, text string")
    got = Counter((r["doc_id"], r["kept"]) for r in without_repeats(df).collect())
    seen, want = set(), {}
    for i, t in sorted(set(made), key=lambda x: (x[0], x[1].encode())):
        raw = t.encode()
        hit = np.zeros(len(raw), bool)
        for s in range(len(raw) - 99):
            w = raw[s : s + 100]
            hit[s : s + 100] |= w in seen
            seen.add(w)
        want[i, t] = np.frombuffer(raw, np.uint8)[~hit].tobytes()
    assert got == Counter((i, want[i, t]) for i, t in made)


def test_frequent_hashes_have_no_fixed_number(spark, monkeypatch):
    """All hashes seen often enough are dealt in parts by their frequency, more than 256 of them here."""
    from curbflow.llm import repeats

    monkeypatch.setattr(repeats, "SAMPLE", 1)
    rng = random.Random(41)
    page = "".join(rng.choices("abcdefgh ", k=12_000))
    texts = spark.createDataFrame([(i, page) for i in range(200)], "doc_id long, text string")
    hashes, parts = repeats.hot_hashes(texts)
    assert len(hashes) > 256 and (np.diff(hashes) > 0).all() and (parts >= 1 + 200 // 64).all()
    kept = {r["doc_id"]: bytes(r["kept"]) for r in without_repeats(texts).collect()}
    assert kept == {i: page.encode() if i == 0 else b"" for i in range(200)}


def test_more_texts_of_an_id_than_places_hold(spark, monkeypatch):
    from curbflow.llm import repeats

    monkeypatch.setattr(repeats, "TEXT", 3)
    made = [(1, str(i) * 120) for i in range(5)]
    texts = spark.createDataFrame(made, "doc_id long, text string").withColumn("nth", F.substring("text", 1, 1).cast("int"))
    none = np.empty(0, np.int64)
    with pytest.raises(Exception, match="doc_id 1 has too many different texts"):
        repeats.anchor_rows(texts.select("doc_id", "nth", "text"), none, none).count()


def test_secret_spans_against_plain_loops():
    """Base spans by a scan of characters, linked ones by all pairs of parts."""
    import re

    from curbflow.llm import secrets

    rng = random.Random(12)
    key = "aB3" + "x9Z" * 12 + "q"
    parts = ["password", "API_KEY", "token", "secret", " = ", ":", "=", '"', "'", "abcdef", "hunter22", "AKIA", "AKIA" + "B7" * 9, "0123456789abcdef" * 2,
             "deadbeef", key, key.lower(), "user=", "jane", "login: ", "client_id=", "xyz99", "https://h.example/p", "\n\n", "\n", " ", " filler " * 30, "é"]
    for _ in range(400):
        t = "".join(rng.choices(parts, k=rng.randrange(1, 14)))
        want = []
        i = 0
        names = ("password", "passwd", "secret", "token", "api_key", "apikey")
        while i < len(t):  # assignments, character by character
            name = next((n for n in names if t[i : i + len(n)].lower() == n), None)
            j = i + len(name) if name else i
            if name:
                j += t[j : j + 1] in ('"', "'")and 1 or 0
                while t[j : j + 1] == " ":
                    j += 1
                ok = t[j : j + 1] in (":", "=") and j < len(t)
                if ok:
                    j += 1
                    while t[j : j + 1] == " ":
                        j += 1
                    j += 1 if t[j : j + 1] in ('"', "'") and j < len(t) else 0
                    k = j
                    while k < len(t) and (t[k].isascii() and t[k].isalnum() or t[k] in "+/_.=-"):
                        k += 1
                    if k > j:
                        if k - j >= 6:
                            want.append(("assign", i, k))
                        i = k
                        continue
            i += 1
        for kind, allowed, head, least in (("access", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "AKIA", 20), ("hex", "0123456789abcdef", "", 24)):
            i = 0
            while i < len(t):
                if t.startswith(head, i) and (head or t[i] in allowed):
                    k = i + len(head)
                    while k < len(t) and t[k] in allowed:
                        k += 1
                    if k > i + len(head):
                        if k - i >= least:
                            want.append((kind, i, k))
                        i = k
                        continue
                i += 1
        got = [(x["kind"], x["start"], x["end"]) for x in secrets.scan(t, 200)]
        assert sorted(x for x in got if x[0] in ("assign", "access", "hex")) == sorted(want), t
        # linked parts, by all pairs
        breaks = [m.start() for m in re.finditer(r"\n[ \t\r]*\n", t)]
        block = lambda s: sum(b <= s for b in breaks)
        clear = lambda m: all(e <= m.start() or s >= m.end() for _, s, e in want)
        keys = [m.span() for m in secrets.BARE_KEY.finditer(t) if clear(m) and secrets.varied(m.group())]
        users = [m.span() for m in secrets.IDENTITY.finditer(t) if clear(m)]
        ends = [m.span() for m in secrets.ENDPOINT.finditer(t)]
        ids, secret = users + [x[1:] for x in want if x[0] == "access"], keys + [x[1:] for x in want if x[0] != "access"]
        near = lambda x, many: any(block(y[0]) == block(x[0]) and y[0] - x[1] <= 200 and x[0] - y[1] <= 200 for y in many)
        linked = [("linked_secret", *x) for x in keys if near(x, ids)] + [("linked_identity", *x) for x in users if near(x, secret)]
        linked += [("linked_endpoint", *x) for x in ends if near(x, ids) and near(x, secret)]
        assert sorted(x for x in got if x[0].startswith("linked")) == sorted(linked), t


def test_language_code_lengths_equal_plain_contexts():
    """Method C with exclusion over dictionaries of contexts."""
    from curbflow.llm.language_id import build

    rng = random.Random(21)
    order, least = 3, 4
    samples = {k: ["".join(rng.choices(a, k=80)).encode() for _ in range(6)] for k, a in (("a", "abcd "), ("b", "abxyé "))}
    trees = build(samples, order=order, min_count=least)
    gap = b"\n" * order
    joined = {k: gap + gap.join(v) for k, v in samples.items()}
    seen = Counter(x[i - d : i] for x in joined.values() for d in range(order + 1) for i in range(order, len(x)))
    known = {c for c, n in seen.items() if n >= least or not c}
    known = {c for c in known if all(c[i:] in known for i in range(len(c)))}
    alphabet = sorted(set(b"".join(joined.values())))
    for column, lang in enumerate(trees.langs):
        x = joined[lang]
        follow = {}
        for i in range(order, len(x)):
            for d in range(order + 1):
                follow.setdefault(x[i - d : i], Counter())[x[i]] += 1
        for t in (b"abcd", "xyé zz".encode(), b"", b"dddd bbbb xyxy \x07"):
            whole, bits = gap + t, 0.0
            for i in range(order, len(whole)):
                context = next(whole[i - d : i] for d in range(order, -1, -1) if whole[i - d : i] in known and all(whole[i - j : i] in known for j in range(d)))
                p, escape, done = None, 1.0, set()
                while True:
                    c = {b: n for b, n in follow.get(context, {}).items() if b not in done}
                    if c:
                        total, kinds = sum(c.values()), len(c)
                        if whole[i] in c:
                            p = escape * c[whole[i]] / (total + kinds)
                            break
                        escape *= kinds / (total + kinds)
                        done |= set(c)
                    if not context:
                        break
                    context = context[1:]
                if p is None:
                    p = escape / (256 - len(done))
                bits -= math.log2(p)
            assert math.isclose(trees.lengths([t])[0, column], bits, rel_tol=1e-4, abs_tol=1e-3), (lang, t)
    assert alphabet


@pytest.mark.parametrize("bits", (6, 25))
def test_filter_before_the_texts_meet(spark, monkeypatch, bits):
    from curbflow.llm import near_duplicates as nd

    monkeypatch.setattr(nd, "FILTER_BITS", bits)
    rows = spark.range(-3000, 3000).selectExpr("id as doc_id", "'t' as text").unionByName(spark.sql("select cast(null as long) doc_id, 'n' text"))
    wanted = spark.range(-3000, 3000, 7).withColumnRenamed("id", "doc_id")
    got = [r["doc_id"] for r in nd.perhaps_wanted(rows, wanted, "doc_id").collect()]
    assert len(got) == len(set(got)) and set(got) >= {r["doc_id"] for r in wanted.collect()}
    assert len(got) < 1000 if bits == 25 else len(got) <= 6001
    assert nd.perhaps_wanted(rows, wanted.limit(0), "doc_id").count() == 0
