"""Links of ids with several texts, bounded samples, and the classifier's training against a plain loop."""

import numpy as np
from pyspark.sql import functions as F

from auditlake.llm import license_scan, lm_score, near_dedup, toxicity
from auditlake.llm._exchange import zip_

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(seed, n):
    return " ".join(np.random.default_rng(seed).choice(WORDS, n))


def test_each_text_of_an_id_keeps_its_links(spark):
    a, b, c = prose(1, 90), prose(2, 90), prose(3, 90)
    rows = [(1, a), (1, b), (2, b + " word"), (3, a + " word"), (4, c), (5, c + " word"), (5, c + " word"), (9, prose(4, 50)), (9, b + " other"), (7, prose(4, 50) + " x")]
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame(order, "doc_id long, text string").repartition(3)
        got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(df).collect()}
        assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 9: 1, 7: 1}


def test_texts_of_an_id_that_copies_hold(spark):
    a, b = prose(5, 80), prose(6, 80)
    df = spark.createDataFrame([(3, a), (3, b), (1, b), (2, a), (4, b + " z"), (5, a + " z"), (6, None), (6, "")], "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(df).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 6: 6}


def test_a_sample_takes_a_repeated_text_once_and_no_more_than_its_bounds(spark):
    df = spark.createDataFrame([(1, "aa bb")] * 500 + [(1, "cc dd ee")] * 3 + [(i, f"word{i} other{i}") for i in range(2, 40)], "id long, text string").repartition(4)
    everyone = df.select("id").distinct()
    assert len(toxicity._sample(df, everyone, 1000, 10**6, 18)) == 40
    assert len(toxicity._sample(df, everyone, 7, 10**6, 18)) == 7
    few = toxicity._sample(df, everyone, 1000, 12, 18)
    assert 1 <= len(few) <= 4
    again = toxicity._sample(df.repartition(9), everyone, 1000, 12, 18)
    assert [x.tolist() for x in few] == [x.tolist() for x in again]


def plain_nnpu(positive, unlabelled, prior, use, steps=300, rate=0.05, decay=3e-4):
    """Dense vectors and one text at a time."""
    dense = lambda rows: np.array([[1.0 if k in set(r.tolist()) else 0.0 for k in use] for r in rows])
    xp, xu = dense(positive), dense(unlabelled)
    theta = np.append(np.zeros(len(use)), np.log(prior / (1 - prior)))
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    sigmoid = lambda z: 1 / (1 + np.exp(-z))
    for step in range(1, steps + 1):
        up, down, loss = np.zeros_like(theta), np.zeros_like(theta), 0.0
        for x in xp:
            x1 = np.append(x, 1.0)
            f = x1 @ theta
            up += prior * (sigmoid(f) - 1) * x1 / len(xp)
            down -= prior * sigmoid(f) * x1 / len(xp)
            loss -= prior * np.log1p(np.exp(f)) / len(xp)
        for x in xu:
            x1 = np.append(x, 1.0)
            f = x1 @ theta
            down += sigmoid(f) * x1 / len(xu)
            loss += np.log1p(np.exp(f)) / len(xu)
        g = (up + down) if loss >= 0 else -down
        g[:-1] += decay * theta[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta = theta - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return theta[:-1], min(theta[-1], np.log(prior / (1 - prior)))


def test_training_equals_a_plain_loop():
    rng = np.random.default_rng(2)
    positive = [np.unique(np.append(rng.integers(0, 50, 6), [3, 7][i % 2])).astype(np.int32) for i in range(20)]
    unlabelled = [np.unique(rng.integers(0, 50, 6) if i % 10 else np.append(rng.integers(0, 50, 5), 3)).astype(np.int32) for i in range(60)]
    weights, bias = toxicity.fit_nnpu(positive, unlabelled, 0.1, bits=6, min_texts=2, surprise=0.5)
    use = np.flatnonzero(weights)
    assert {3, 7} <= set(use.tolist())
    want, want_bias = plain_nnpu(positive, unlabelled, 0.1, use.tolist())
    assert np.abs(weights[use] - want).max() < 1e-4 and abs(bias - want_bias) < 1e-4


def test_scores_with_an_id_of_many_rows(spark):
    docs = spark.createDataFrame([(1, "vile words here")] * 300 + [(i, f"good words {i}") for i in range(2, 60)] + [(i, "vile vile things") for i in range(60, 70)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1)] + [(i, 0) for i in range(2, 60)] + [(i, 1) for i in range(60, 70)], "doc_id long, toxic int")
    got = toxicity.score_toxicity(docs, labels)
    assert got.count() == 368 and got.where("score is null or score < 0 or score > 1").count() == 0
    assert toxicity.score_toxicity(docs.limit(0), labels).count() == 0
    assert got.where(F.col("doc_id") == 1).select("score").distinct().count() == 1


def test_counts_and_seats_beyond_32_bits():
    row = {"bucket": 1, "words": zip_(np.array([7, 9], "<u8")), "lens": zip_(np.array([2, 1], "<u4")), "contexts": zip_(np.array([3, 5, 3], "<u2")), "counts": zip_(np.array([6 * 10**9, 2, 1], "<u8"))}
    rest = lm_score._Restaurants(row)
    assert rest.c2.tolist() == [6 * 10**9, 2, 1] and rest.seen.tolist() == [6 * 10**9 + 2, 1]
    seats = (np.array([5 * 10**9, 2, 1]), *(np.full(len(x), 5 * 10**9) for x in rest.first()[1:]))
    assert [x.tolist() for x in lm_score._seats(lm_score._zipped(seats), rest)] == [x.tolist() for x in seats]
    assert rest.totals(rest.first()).sum() > 6 * 10**9


def test_each_template_states_its_share(spark):
    templates = (("short", "one two three four", 1.0), ("loose", "aa bb cc dd ee ff gg hh ii jj", 0.5), ("tight", "aa bb cc dd kk ll mm nn oo pp", 0.9))
    rows = [(1, "one two three"), (2, "x one two three four y"), (3, "aa bb cc dd ee"), (4, "aa bb cc dd"), (5, "aa bb cc dd kk ll mm nn oo"), (6, "aa bb cc dd kk ll mm nn")]
    got = {r["doc_id"]: (r["labels"], r["score"]) for r in license_scan.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string"), templates=templates, phrases=()).collect()}
    assert got == {1: ("", 0.0), 2: ("short", 1.0), 3: ("loose", 0.5), 4: ("", 0.0), 5: ("tight", 0.9), 6: ("", 0.0)}


def test_a_passage_on_every_page_is_one_entry_a_group_of_pages(spark, monkeypatch):
    from auditlake.llm import substring_dedup

    monkeypatch.setattr(substring_dedup, "PAGE_ROWS", 2)
    monkeypatch.setattr(substring_dedup, "FAN", 8)
    monkeypatch.setattr(substring_dedup, "BUCKET_BYTES", 4000)
    passage = prose(77, 40)
    rows = [(i, f"{prose(1000 + i, 12)} {passage if i % 3 else prose(3000 + i, 40)} {prose(2000 + i, 12)}") for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    seen, gone = {}, {}
    for i, t in rows:  # every window's first document
        w = t.split()
        for p in range(len(w) - 12):
            seen.setdefault(tuple(w[p : p + 13]), i)
    for i, t in rows:
        w = t.split()
        gone[i] = len({p + k for p in range(len(w) - 12) if seen[tuple(w[p : p + 13])] < i for k in range(13)})
    got = {r["doc_id"]: r["n_removed"] for r in substring_dedup.dedup_substrings(df).collect()}
    assert got == gone and sum(n > 0 for n in gone.values()) >= 79
    combined = substring_dedup._combined(np.array([5, 5, 9], "<u4"), np.array([7, 3, substring_dedup.NEVER]), np.array([7, 8, 2]))
    assert [x.tolist() for x in combined] == [[5, 9], [3, int(substring_dedup.NEVER)], [8, 2]]
    assert [x.tolist() for x in substring_dedup._repeated(*combined)] == [[5], [3]]
