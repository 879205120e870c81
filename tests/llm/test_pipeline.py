"""The pipeline's stages on awkward documents, and very long texts through the operators."""

import numpy as np
import pytest

import corpus_pipeline
from auditlake.llm import license_scan, lm_score, near_dedup, substring_dedup, toxicity

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed, n):
    return " ".join(np.random.default_rng(seed).choice(WORDS, n))


LINES = "\n".join(f"line {i} of a shared block" for i in range(6))
ROWS = [
    (1, prose(1, 70)),
    (2, prose(1, 70)),  # a copy
    (3, prose(2, 60) + "\n" + LINES),
    (4, prose(3, 60) + "\n" + LINES),  # lines that an earlier document has
    (5, None),
    (6, ""),
    (7, " \n \t "),
    (None, prose(4, 50)),
    (None, None),
    (8, prose(5, 40)),
    (8, prose(5, 40)),  # a row twice
    (9, prose(6, 40)),
    (9, prose(7, 40)),  # an id twice
    (10, "one"),
]


@pytest.fixture(scope="module")
def labels(spark, tmp_path_factory):
    where = str(tmp_path_factory.mktemp("labels"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    return where


def run(spark, docs, where):
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, where).cache()
    return docs, corpus_pipeline.STAGES[-1][1](spark, docs, where)


def test_stages_on_awkward_documents(spark, labels):
    docs = spark.createDataFrame([(i, t, "en", None, None if t is None else len(t)) for i, t in ROWS], SCHEMA).repartition(3)
    kept, packed = run(spark, docs, labels)
    assert kept.columns == docs.columns
    got = {}
    for r in kept.collect():
        got.setdefault(r["doc_id"], []).append(r["text"])
    assert 2 not in got and got[1] == [prose(1, 70)]
    assert got[4] == [prose(3, 60)] and got[3][0].endswith(LINES.split("\n")[-1])
    assert got[5] == [None] and got[6] == [""] and len(got[7]) == 1 and len(got[None]) == 2
    assert len(got[8]) == 2 and len(got[9]) == 2 and got[10] == ["one"]
    assert packed.count() == kept.count()


def test_stages_keep_columns_with_clashing_names(spark, labels):
    clash = "text2 string, score string, predicted string, kept string, component_id string, n_words string, n_removed string, n_lines string, _key string"
    rows = [(i, t, "en", "s", 1, *["own"] * 9) for i, t in ROWS if i is not None and t]
    docs = spark.createDataFrame(rows, f"{SCHEMA}, {clash}")
    kept, packed = run(spark, docs, labels)
    assert kept.columns == docs.columns and packed.count() == kept.count()
    assert {tuple(r) for r in kept.select("text2", "score", "predicted", "kept", "component_id", "n_words", "n_removed", "n_lines", "_key").collect()} == {("own",) * 9}


def test_stages_on_an_empty_table(spark, labels):
    kept, packed = run(spark, spark.createDataFrame([], SCHEMA), labels)
    assert kept.count() == packed.count() == 0


def test_very_long_texts_pass_whole(spark):
    body = prose(11, 400_000)  # about 2.5 MB
    passage = prose(12, 80)
    rows = [(1, f"{passage} one"), (2, f"{body} {passage} cc by {body[:1000]}"), (3, f"{body} {passage} cc by {body[:1000]} tail"), (4, prose(13, 30))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    licences = {r["doc_id"]: r for r in license_scan.scan_licenses(df).collect()}
    assert licences[2]["base_labels"] == "cc-by" and licences[2]["first_word"] == 400_080 and licences[2]["n_words"] == len(rows[1][1].split())
    near = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(df).collect()}
    assert near == {1: 1, 2: 2, 3: 2, 4: 4}
    left = {r["doc_id"]: r for r in substring_dedup.dedup_substrings(df).collect()}
    assert left[2]["n_words"] == len(rows[1][1].split()) and left[2]["n_removed"] >= 80 and left[3]["n_removed"] == left[3]["n_words"] - 1
    scored = {r["doc_id"]: r for r in lm_score.score_documents(df).collect()}
    assert scored[2]["n_tokens"] == len(rows[1][1].split()) + 1 and scored[2]["score"] < scored[4]["score"] < 0
    assert len(toxicity.features(rows[1][1])) <= 3 * (len(WORDS) + 4)
