"""The pipeline's stages, each against what brute force says about its own input."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from curbflow.llm.common import table

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    """The smallest tables with 60 toxic and 60 clean documents more, of which two thirds are labelled."""
    folder = str(tmp_path_factory.mktemp("planted"))
    docs, rng = table(spark, SF, "documents"), random.Random(3)
    rows = []
    for i in range(120):
        words = [f"{rng.choice(['ther', 'on', 'esh', 'ble'])}{rng.choice(['an', 'wh', 'ing', 'or', 'ut'])}{i % 7}" for _ in range(rng.randrange(20, 90))]
        if i % 2:
            at = rng.randrange(len(words))
            words[at:at] = rng.choices(["slimeball", "rotbrain", "vilefool"], k=4)
        rows.append((10**6 + i, " ".join(words), "en", "planted", 1))
    docs.unionByName(spark.createDataFrame(rows, docs.schema)).write.parquet(f"{folder}/documents.parquet")
    labels = table(spark, SF, "labels")
    known = spark.createDataFrame([(i, 1, i % 2) for i, *_ in rows if i % 3], labels.schema)
    labels.unionByName(known).write.parquet(f"{folder}/labels.parquet")
    table(spark, SF, "benchmark").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def test_stages(spark, planted):
    docs = table(spark, planted, "documents")
    columns = docs.columns
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, planted)
        if name != "packing":
            assert out.columns == columns
        docs = spark.createDataFrame(out.collect(), out.schema)
        sizes.append(docs.count())
        if name == "toxicity":
            left = {r["doc_id"] for r in docs.where("doc_id >= 1000000").collect()}
            assert sum(i % 2 for i in left) <= 3 and sum(1 - i % 2 for i in left) >= 58
            original = {r["doc_id"] for r in docs.where("doc_id < 1000000").collect()}
            clean = {r["doc_id"] for r in table(spark, SF, "labels").where("toxic = 0").collect()}
            assert clean <= original  # nothing that is labelled clean goes
    assert sizes[0] > sizes[1] >= sizes[2] >= sizes[3] == sizes[4] > 0


def test_stages_of_an_empty_table(spark):
    docs = table(spark, SF, "documents").where("false")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert out.count() == 0, name


def test_near_duplicate_stage_keeps_one_of_each_group(spark):
    made = [(i, "a b c d e f g", "en", "s", 13) for i in (4, 3, 3, 9)] + [(None, "a b c d e f g", "en", "s", 13), (7, "", "en", "s", 0)]
    docs = spark.createDataFrame(made, "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.drop_near_duplicates(spark, docs, SF)
    assert sorted((r["doc_id"] or -1) for r in out.collect()) == [-1, 3, 7]


def kept_by_brute_force(docs):
    """The ids that stay: the smallest of each group linked by a Jaccard of 0.8 or more."""
    sets = {}
    for r in docs:
        w = (r["text"] or "").encode().lower().split()
        sets[r["doc_id"]] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    group = {i: i for i in sets}

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= 80 * (len(sets[a]) + len(sets[b]) - common):
                low, high = sorted((root(a), root(b)))
                group[high] = low
    return {i for i in ids if root(i) == i}


def test_near_duplicate_stage_against_brute_force(spark):
    docs = table(spark, SF, "documents").limit(400)
    made = [r.asDict() for r in docs.collect()]
    words = [f"w{i}" for i in range(204)]
    for k, changed in enumerate((24, 22, 20, 19, 17)):  # a cut end: Jaccard (204 - 2 n) / 200, 0.78 to 0.85
        of = [f"{w}g{k}" for w in words]
        made += [made[0] | {"doc_id": 10**9 + 2 * k, "text": " ".join(of)}, made[0] | {"doc_id": 10**9 + 2 * k + 1, "text": " ".join(of[: 204 - 2 * changed + 4])}]
    docs = spark.createDataFrame([tuple(m.values()) for m in made], docs.schema)
    out = {r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, docs, SF).collect()}
    assert out == kept_by_brute_force(docs.collect())


def test_contaminated_documents_go(spark):
    item = table(spark, SF, "benchmark").where(F.length("text") > 80).first()["text"]
    made = [(1, f"before {item} after"), (2, "clean words only, nothing else to see here at all today my friend")]
    docs = spark.createDataFrame(made, "doc_id long, text string")
    assert [r["doc_id"] for r in corpus_pipeline.drop_contaminated(spark, docs, SF).collect()] == [2]


def test_redaction_keeps_documents(spark):
    made = [(1, 'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" end', 55), (2, None, None)]
    docs = spark.createDataFrame(made, "doc_id long, text string, n_chars long")
    got = {r["doc_id"]: r for r in corpus_pipeline.redact(spark, docs, SF).collect()}
    assert got[1]["text"].endswith('" end') and "24be" not in got[1]["text"] and got[1]["n_chars"] == len(got[1]["text"])
    assert got[2]["text"] is None
