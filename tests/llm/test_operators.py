"""The operators against brute force on small, awkward tables."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from auditlake.llm import ann, fingerprint, license_scan, lm_score, near_dedup, packing, queries, sentencepiece_scan, substring_dedup, toxicity
from auditlake.llm.components import connected_components
from auditlake.llm.line_dedup import dedup_lines

SCHEMA = "doc_id long, text string, n_words string, n_removed string, score string, kept string"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(seed, n):
    return " ".join(np.random.default_rng(seed).choice(WORDS, n))


PASSAGE = prose(900, 60)
TEXTS = [
    (0, prose(1, 80)),
    (1, prose(1, 80)),  # exact copy
    (2, prose(1, 80).replace("alpha", "ALPHA", 1) + " omega"),  # near copy
    (3, f"{prose(2, 30)} {PASSAGE} {prose(3, 30)}"),
    (4, f"{PASSAGE}\t{prose(4, 200)}"),
    (5, "one\ntwo\nthree\nfour\nfive"),
    (6, "zero\none\ntwo\nthree\nsix\none\ntwo\nthree"),
    (7, ""),
    (8, None),
    (9, " \n\n\n\n "),
    (10, "a"),
    (11, "x " * 3000),
    (12, "Straße ñandú 日本語 🙂 ▁ é" * 20),
    (13, "Licensed under the Apache License, Version 2.0.\nCC BY cc-by All Rights Reserved"),
    (14, "one two three"),
    (15, "one two three"),
    (None, prose(5, 40)),
    (None, None),
    (16, prose(6, 20)),
    (16, prose(6, 20)),  # a row twice
    (16, prose(7, 20)),  # an id twice
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "clash", "clash", "clash", "clash") for i, t in TEXTS], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(t):
    return [w.decode() for w in (t or "").encode().split()]


def by_row(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


def test_line_dedup(docs, empty):
    order = sorted({(i is None, i or 0, t) for i, t in TEXTS if t is not None}, key=lambda x: (x[0], x[1]))
    got = {(r["doc_id"], r["text"]) for r in dedup_lines(docs).collect()}
    assert (5, "one\ntwo\nthree\nfour\nfive") in got  # the first occurrence stays
    assert (6, "zero\nsix") in got  # both later ones go
    assert (8, None) in got and (7, "") in got and (9, " \n\n\n\n ") in got
    assert len(order) and dedup_lines(docs).count() == len(TEXTS)
    assert dedup_lines(empty).count() == 0
    r = dedup_lines(docs).where("doc_id = 6").first()
    assert (r["n_lines"], r["n_removed"], r["kept"]) == (8, 6, "clash")


def test_line_dedup_overlaps(spark):
    df = spark.createDataFrame([(1, "a\na\na\na\na"), (2, "a\na\nb\na\na\na")], "doc_id long, text string")
    assert by_row(dedup_lines(df), "doc_id", "text") == [(1, "a"), (2, "a\na\nb")]


def brute_lines(rows, window=3):
    seen, out = set(), []
    for i, t in sorted(rows):
        lines, gone = t.split("\n"), set()
        for p in range(len(lines) - window + 1):
            w = tuple(lines[p : p + window])
            gone |= set(range(p, p + window)) if w in seen else set()
            seen.add(w)
        out.append((i, "\n".join(x for k, x in enumerate(lines) if k not in gone)))
    return out


def test_line_dedup_by_brute_force_and_on_a_long_text(spark):
    rng = np.random.default_rng(3)
    rows = [(i, "\n".join(rng.choice(list("abc"), int(rng.integers(1, 40))))) for i in range(60)]
    rows += [(100 + i, "\n".join(f"line {k}" if k % 50 else f"own {i} {k}" for k in range(60_000))) for i in range(2)]
    assert by_row(dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")), "doc_id", "text") == sorted(brute_lines(rows), key=repr)


def test_license_scan(docs, empty):
    rows = {r["doc_id"]: r for r in license_scan.scan_licenses(docs).where("doc_id <> 16").collect()}
    r = rows[13]
    assert (r["base_labels"], r["labels"], r["score"]) == ("cc-by,reserved", "apache,cc-by,reserved", 1.0)
    assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (15, 3, 8, 12)
    assert (rows[8]["n_words"], rows[8]["first_word"], rows[8]["labels"]) == (0, None, "")
    assert license_scan.scan_licenses(docs).count() == len(TEXTS)
    assert license_scan.scan_licenses(empty).count() == 0


def test_license_scan_tells_short_statements_apart(spark):
    df = spark.createDataFrame(list(enumerate(t for _, t, _ in license_scan.TEMPLATES)) + [(90, "licensed under the eclipse license version 2 0")], "doc_id long, text string")
    got = {r["doc_id"]: r["labels"] for r in license_scan.scan_licenses(df, phrases=()).collect()}
    assert [got[i] for i in range(len(license_scan.TEMPLATES))] == [label for label, _, _ in license_scan.TEMPLATES] and got[90] == ""


def test_license_scan_finds_a_statement_anywhere(spark):
    label, statement, _ = license_scan.TEMPLATES[1]
    rows = [(n, " ".join(["word"] * n + statement.split()[:-1] + ["word"] * (200 - n))) for n in range(0, 200, 7)]
    got = license_scan.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string"))
    assert got.where(F.col("labels") != label).count() == 0


def test_sentencepiece(docs, empty):
    path = queries.SENTENCEPIECE_MODEL
    table = sentencepiece_scan.Pieces.load(path)
    pieces = sentencepiece_scan.Pieces(table)

    def best(text):  # plain dynamic programming
        marked = "▁" + text.replace(" ", "▁") if text else ""
        out = [0.0] + [-math.inf] * len(marked)
        for end in range(1, len(marked) + 1):
            for at in range(max(0, end - pieces.longest), end):
                i = pieces.ids.get(marked[at:end])
                s = table[i][1] if i is not None else pieces.unknown_score if end - at == 1 else -math.inf
                out[end] = max(out[end], out[at] + s)
        return out[-1]

    ids = None
    for chunk in (1 << 15, 200, 41):
        got = sentencepiece_scan.encode_documents(docs, path, chunk=chunk, fan=3)
        now = by_row(got, "doc_id", "ids")
        assert ids in (None, now)  # the same ids wherever texts are cut
        ids = now
        decoded = sentencepiece_scan.decode_documents(got, path).where("doc_id <> 16").collect()
        assert got.count() == len(TEXTS)
        known = dict(TEXTS)
        for r in decoded:
            if r["doc_id"] is None:
                continue
            t = known[r["doc_id"]]
            assert r["decoded"] == (None if t is None else t.replace("▁", " "))
            assert r["token_score"] is None if t is None else r["token_score"] == pytest.approx(best(t))
    assert sentencepiece_scan.encode_documents(empty, path).count() == 0


def test_sentencepiece_ids_do_not_depend_on_cuts(spark):
    """Over texts without marks or with ties everywhere, and the library's own pieces at score ties."""
    rng, path = np.random.default_rng(9), queries.SENTENCEPIECE_MODEL
    rows = [(i, "".join(rng.choice(list("aab eéss"), int(rng.integers(30, 160))))) for i in range(40)]
    rows += [(100 + i, "".join(rng.choice(list("ab"), 300))) for i in range(10)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    whole = by_row(sentencepiece_scan.encode_documents(df, path), "doc_id", "ids")
    for chunk, fan in ((20, 2), (33, 3), (64, 64)):
        assert by_row(sentencepiece_scan.encode_documents(df, path, chunk=chunk, fan=fan), "doc_id", "ids") == whole


def test_transfer_matrices_combine():
    pieces = sentencepiece_scan.Pieces(sentencepiece_scan.Pieces.load(queries.SENTENCEPIECE_MODEL))
    text, size = "▁" + "supercalifragilistic" * 3 + "▁and▁more", pieces.longest
    for n in (7, 20, 33):
        cut = [(text[a : a + n + size - 1], min(n, len(text) - a)) for a in range(0, len(text), n)]
        total = pieces.transfer(*cut[0])
        for c in cut[1:]:
            total = sentencepiece_scan.product(total, pieces.transfer(*c))
        assert total[0, 0] == pytest.approx(pieces.encode(text)[0])


def brute_substrings(rows, window=13):
    first = {}
    for i, t in rows:
        w = words(t)
        for p in range(len(w) - window + 1):
            k = tuple(w[p : p + window])
            first[k] = min(first.get(k, math.inf), math.inf if i is None else i)
    out = []
    for i, t in rows:
        w, gone = words(t), set()
        for p in range(len(w) - window + 1):
            if first[tuple(w[p : p + window])] < (math.inf if i is None else i):
                gone.update(range(p, p + window))
        out.append((i, len(w), len(gone), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest()))
    return sorted(out, key=repr)


def test_substring_dedup(docs, empty):
    out = substring_dedup.dedup_substrings(docs)
    got = sorted(((r["doc_id"], r["n_words"], r["n_removed"], hashlib.sha256(" ".join(words(r["text"])).encode()).hexdigest()) for r in out.collect()), key=repr)
    assert got == brute_substrings(TEXTS)
    assert substring_dedup.dedup_substrings(empty).count() == 0


@pytest.mark.parametrize("bucket_bytes, fan", [(4000, 4096), (400, 4)])
def test_substring_dedup_over_pages_and_buckets(spark, monkeypatch, bucket_bytes, fan):
    """One level of exchange, and several."""
    monkeypatch.setattr(substring_dedup, "BUCKET_BYTES", bucket_bytes)
    monkeypatch.setattr(substring_dedup, "FAN", fan)
    monkeypatch.setattr(substring_dedup, "PAGE_ROWS", 7)
    rng = np.random.default_rng(5)
    shared = [prose(50 + i, 40) for i in range(6)]
    rows = [(int(i), " ".join([prose(1000 + i, int(rng.integers(0, 40))), shared[i % 6], prose(3000 + i, 20)])) for i in rng.permutation(150)]
    out = substring_dedup.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))
    got = sorted(((r["doc_id"], r["n_words"], r["n_removed"], hashlib.sha256(" ".join(words(r["text"])).encode()).hexdigest()) for r in out.collect()), key=repr)
    assert got == brute_substrings(rows)


def check_packing(rows, lengths):
    bins = collections.defaultdict(list)
    for r in rows:
        at = 0
        for k, p in enumerate(r["pieces"]):
            assert p["piece"] == k and p["capacity"] in lengths
            bins[p["bin_id"], p["capacity"]].append((p["at"], p["n"]))
            at += p["n"]
        assert at == r["n_tokens"]
    for (_, capacity), parts in bins.items():
        used = 0
        for a, n in sorted(parts):
            assert a == used
            used += n
        assert used <= capacity and not [c for c in lengths if used <= c < capacity]  # downsized
    assert len({b for b, _ in bins}) == len(bins)
    return sum(n for x in bins.values() for _, n in x) / sum(c for _, c in bins)


def test_packing(docs, empty):
    rows = packing.pack_documents(docs, lengths=(64, 128, 256)).collect()
    assert len(rows) == len(TEXTS)
    assert sorted(r["n_tokens"] for r in rows) == sorted(len(words(t)) + 1 for _, t in TEXTS)
    check_packing(rows, (64, 128, 256))
    assert packing.pack_documents(empty).count() == 0


def plain_pack(items, lengths):
    """The same rule with lists and no bookkeeping."""
    bins = []  # [capacity, contents]
    out = []
    for k, n in enumerate(items):
        fits = [b for b in bins if b[0] - sum(b[1]) >= n]
        if fits:
            target = min(fits, key=lambda b: (b[0] - sum(b[1]), bins.index(b)))
        else:
            tried = []
            for c in lengths:
                if c < n:
                    continue
                held = n
                for m in sorted(items[k + 1 :], reverse=True):
                    if held + m <= c:
                        held += m
                end = min(x for x in lengths if x >= held)
                tried.append(((end - held) / held, -c))
            target = [-min(tried)[1], [], len(bins)]
            bins.append(target)
        target[1].append(n)
        out.append(target[2])
    return out, [min(x for x in lengths if x >= sum(b[1])) for b in bins]


def test_packing_follows_the_rule():
    rng = np.random.default_rng(12)
    opened = set()
    for lengths in ((8, 16, 32), (10, 15), (7, 12, 20)):
        for _ in range(60):
            items = sorted(rng.integers(1, lengths[-1] + 1, rng.integers(1, 14)).tolist(), reverse=True)
            bins, _, size = packing.pack(items, lengths)
            assert (bins, size) == plain_pack(items, lengths)
            opened |= {(lengths, s) for s in size}
    assert len(opened) == 8


def least_capacity(items, lengths):
    """Of all partitions of a few items."""
    best = [math.inf]

    def go(i, bins):
        if i == len(items):
            best[0] = min(best[0], sum(min(x for x in lengths if x >= b) for b in bins))
            return
        for k in range(len(bins)):
            if bins[k] + items[i] <= lengths[-1]:
                go(i + 1, [*bins[:k], bins[k] + items[i], *bins[k + 1 :]])
        go(i + 1, [*bins, items[i]])

    go(0, [])
    return best[0]


def test_packing_is_near_the_optimum_of_small_cases():
    rng = np.random.default_rng(13)
    ours = least = 0
    for _ in range(60):
        items = sorted(rng.integers(1, 33, 7).tolist(), reverse=True)
        size = packing.pack(items, (8, 16, 32))[2]
        ours, least = ours + sum(size), least + least_capacity(items, (8, 16, 32))
    assert ours <= 1.05 * least


def test_packing_is_tight(spark):
    sizes = np.random.default_rng(2).integers(1, 3000, 400).tolist()
    rows = packing.pack_documents(spark.createDataFrame([(i, "w " * n) for i, n in enumerate(sizes)], "doc_id long, text string")).collect()
    assert check_packing(rows, packing.LENGTHS) > 0.95


def test_fingerprint(docs, empty, spark):
    rows = [(i, t) for i, t in TEXTS if i is not None and i != 16]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in fingerprint.fingerprint_documents(df).collect()}
    down = sorted(rows, key=lambda r: -r[0])
    for (i, t), (_, u) in zip(down, down[1:] + down[:1]):
        t, u = t or "", u or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + u[:half]
        r = got[i]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        a, b, c = (fingerprint.fingerprint(x.encode()) for x in (t, edited, u))
        assert (r["fingerprint"], r["edited_fingerprint"]) == (fingerprint.as_text(a), fingerprint.as_text(b))
        assert (r["near_edited"], r["near_next"]) == (fingerprint.likeness(a, b), fingerprint.likeness(a, c))
    assert got[0]["fingerprint"] == got[1]["fingerprint"]
    assert fingerprint.fingerprint_documents(docs).count() == len(TEXTS)
    assert fingerprint.fingerprint_documents(empty).count() == 0


def test_fingerprint_over_ranges(spark, monkeypatch):
    rows = [(i * 3, prose(i, 30)) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    one = by_row(fingerprint.fingerprint_documents(df), "doc_id", "edited_sha256", "near_next")
    monkeypatch.setattr(fingerprint, "RANGE_BYTES", 1000)
    assert by_row(fingerprint.fingerprint_documents(df), "doc_id", "edited_sha256", "near_next") == one


def test_fingerprint_of_rows_that_share_ids(spark, monkeypatch):
    """Neighbours are by id downwards, then by the texts' hashes, over ranges that cut through an id."""
    rows = [(5, prose(i, 20)) for i in range(30)] * 2 + [(i, prose(100 + i, 20)) for i in range(9)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    one = by_row(fingerprint.fingerprint_documents(df), "doc_id", "edited_sha256", "near_next", "near_edited")
    assert len(one) == len(rows)
    monkeypatch.setattr(fingerprint, "RANGE_BYTES", 300)
    assert by_row(fingerprint.fingerprint_documents(df), "doc_id", "edited_sha256", "near_next", "near_edited") == one


def plain_boundaries(data):
    """Byte by byte: the gear hash rolls, and each byte is asked whether its chunk may end after it."""
    ends, start, h = [], 0, 0
    for i, byte in enumerate(data):
        h = ((h << 1) + int(fingerprint._GEAR[byte])) & 0xFFFFFFFF
        n = i + 1 - start
        bits = fingerprint.NORMAL_BITS + 2 if n < 1 << fingerprint.NORMAL_BITS else fingerprint.NORMAL_BITS - 2
        if n >= fingerprint.MOST or i + 1 == len(data) or (n >= fingerprint.LEAST and h >> (32 - bits) == 0):
            ends.append(i + 1)
            start = i + 1
    return ends


def test_chunk_boundaries_byte_by_byte():
    rng = np.random.default_rng(7)
    for n in (1, 31, 33, 500, 20_000):
        for letters in (4, 256):
            data = rng.integers(0, letters, n, dtype=np.uint8)
            assert fingerprint.boundaries(data) == plain_boundaries(data.tolist())
    same = np.zeros(5000, np.uint8)
    assert fingerprint.boundaries(same) == plain_boundaries(same.tolist())


def test_chunks_shift_with_an_insertion():
    text = " ".join(prose(i, 50) for i in range(40)).encode()
    a, b = fingerprint.fingerprint(text), fingerprint.fingerprint(b"inserted " + text)
    assert fingerprint.likeness(a, b) > 0.9 and sum(a.values()) <= len(text)


def test_lm_score(docs, empty):
    rows = lm_score.score_documents(docs).collect()
    assert len(rows) == len(TEXTS)
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    tokens = lambda t: (t or "").encode().lower().split() + [b""]
    count = collections.Counter(w for i, t in TEXTS if not held(i) for w in tokens(t))
    total, kinds = sum(count.values()), len(count)
    want = sorted((str(i), held(i), len(tokens(t)), sum(w in count for w in tokens(t)), total, round(sum(math.log10((count[w] + 1) / (total + kinds + 1)) for w in tokens(t)), 6)) for i, t in TEXTS)
    assert sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in rows) == want
    assert all(-1e6 < r["score"] < 0 for r in rows)
    assert lm_score.score_documents(empty).count() == 0


def seated_singly(n, own, above, size, discount, rng):
    t = int(n > 0)
    for i in range(1, n):
        w = (own + discount * t) * (above + t) / (size + t)
        t += rng.random() * (w + i - discount * t) < w
    return t


def test_lm_seats_follow_the_restaurant_process():
    rng = np.random.default_rng(5)
    full = lambda x: np.full(40_000, x)
    many = lambda n, own, above, size, d, **kw: lm_score.seat(full(n), full(own), full(above), full(size), d, rng, **kw)
    for own, above, size in ((2.0, 1e12, 1e12), (0.2, 3.0, 9.0)):
        w = (own + 0.75) * (above + 1) / (size + 1)
        assert (many(2, own, above, size, 0.75) == 2).mean() == pytest.approx(w / (w + 0.25), abs=0.01)
    for n, own, above, size, d in ((50, 5.0, 40.0, 60.0, 0.6), (30, 0.3, 2.0, 30.0, 0.4), (400, 5.0, 40.0, 60.0, 0.6)):
        plain = [seated_singly(n, own, above, size, d, rng) for _ in range(3000)]
        got = many(n, own, above, size, d)
        assert got.mean() == pytest.approx(np.mean(plain), rel=0.02) and got.std() == pytest.approx(np.std(plain), rel=0.06)
    assert lm_score.seat(np.array([0, 1, 3]), np.ones(3), np.ones(3), np.ones(3), 0.5, rng).tolist()[:2] == [0, 1]


def test_lm_probabilities_sum_to_one_after_every_sweep(spark, monkeypatch):
    """Over all words and the unknown one, in several contexts, with the totals that the sweeps themselves share."""
    monkeypatch.setattr(lm_score, "BUCKET_BYTES", 3000)
    seen = []
    sampled = lm_score.sample
    monkeypatch.setattr(lm_score, "sample", lambda *a: seen.append(sampled(*a)) or seen[-1])
    rng = np.random.default_rng(0)
    rows = [(i, " ".join(rng.choice(WORDS, 100, p=np.arange(20, 0, -1) / 210))) for i in range(40)]
    lm_score.score_documents(spark.createDataFrame(rows, "doc_id long, text string")).count()
    cells, states = seen[0]
    buckets = cells.collect()
    assert len(buckets) > 3 and len(states) == 3
    for k, state in enumerate(states):
        (d2, d1, d0), (c_2, c_1, c_0), (t_2, t_1, t_0), s = state.discount, state.customers, state.tables, state.strength
        root, parent, cell = {}, {}, {}
        for row in buckets:
            rest = lm_score._Restaurants(row.asDict())
            p2, p1, p0 = rest.predictive(lm_score._seats(row["seats"][k], rest), state)
            root |= {(row["bucket"], w): p for w, p in enumerate(p0)}
            parent |= {(row["bucket"], w, u): p for w, u, p in zip(rest.up0, rest.u1, p1)}
            cell |= {(row["bucket"], w, u): p for w, u, p in zip(rest.word, rest.u2, p2)}
        unknown = (s + d0 * t_0) * state.base / (s + c_0)
        assert sum(root.values()) + unknown == pytest.approx(1)
        for u in list({u for _, _, u in cell})[:5]:
            up = u // (lm_score.CONTEXTS // lm_score.PARENTS)
            below = lambda p: (s + d1 * t_1[up]) * p / (s + c_1[up])  # noqa: E731, B023
            least = lambda p: (s + d2 * t_2[u]) * p / (s + c_2[u])  # noqa: E731, B023
            middle = {w: parent.get((*w, up), below(p)) for w, p in root.items()} | {None: below(unknown)}
            assert sum(middle.values()) == pytest.approx(1)
            assert sum(cell.get((*w, u) if w else None, least(p)) for w, p in middle.items()) == pytest.approx(1)


def test_lm_score_over_pages_buckets_and_levels(spark, monkeypatch):
    """The base score, and better held-out scores than it, whatever the exchange."""
    rng = np.random.default_rng(1)
    chain = {w: rng.permutation(WORDS)[:3] for w in WORDS}
    rows = []
    for i in range(150):
        w = [WORDS[i % 20]]
        for _ in range(60):
            w.append(str(rng.choice(chain[w[-1]])))
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    whole = {r["doc_id"]: r for r in lm_score.score_documents(df).collect()}
    monkeypatch.setattr(lm_score, "BUCKET_BYTES", 2000)
    monkeypatch.setattr(lm_score, "FAN", 4)
    monkeypatch.setattr(substring_dedup, "PAGE_ROWS", 9)
    parts = {r["doc_id"]: r for r in lm_score.score_documents(df).collect()}
    out = [i for i, r in whole.items() if r["held_out"]]
    total = lambda rows, c: sum(rows[i][c] for i in out)
    assert total(whole, "base_score") == pytest.approx(total(parts, "base_score"))
    assert total(whole, "score") == pytest.approx(total(parts, "score"), rel=0.02)
    assert total(whole, "score") > 0.6 * total(whole, "base_score")


def brute_components(rows, threshold=75):
    sets = {}
    for n, (i, t) in enumerate(rows):
        w = words((t or "").encode().lower().decode())
        sets[n] = {tuple(w)} if 0 < len(w) < 5 else {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
    label = {i: i for i, _ in rows if i is not None}

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    live = [n for n, (i, _) in enumerate(rows) if i is not None and sets[n]]
    for a in live:
        for b in live:
            k = len(sets[a] & sets[b])
            if a < b and 100 * k >= threshold * (len(sets[a]) + len(sets[b]) - k):
                x, y = sorted((find(rows[a][0]), find(rows[b][0])))
                label[y] = x
    return sorted(((i, len(sets[n]), None if i is None else find(i)) for n, (i, _) in enumerate(rows)), key=repr)


def test_near_dedup(docs, empty):
    assert by_row(near_dedup.near_duplicates(docs), "doc_id", "n_shingles", "component_id") == brute_components(TEXTS)
    assert near_dedup.near_duplicates(empty).count() == 0


def test_near_dedup_in_blocks(spark):
    """A chain of copies that drift apart, compared in blocks far smaller than the family."""
    rng, rows, now = np.random.default_rng(8), [], [f"w{i}" for i in range(120)]
    for i in range(60):
        rows.append((int(1000 - i), " ".join(now)))
        now = now.copy()
        for k in rng.integers(0, 120, 2):
            now[k] = f"x{i}{k}"
    rows += [(i, prose(400 + i, 60)) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_components(rows)
    assert by_row(near_dedup.near_duplicates(df, block=8), "doc_id", "n_shingles", "component_id") == want
    assert by_row(near_dedup.near_duplicates(df), "doc_id", "n_shingles", "component_id") == want


def test_near_dedup_where_every_bucket_has_a_dissimilar_first_member(spark):
    """Two near copies; for each bucket they share, a text of a smaller id that quotes just the four minima of it."""
    passage = [f"p{i}" for i in range(60)]
    copies = [" ".join(passage + [f"{c}{i}" for i in range(5)]) for c in "ab"]
    a, b = near_dedup._coefficients(144)
    sign = lambda text: near_dedup.minima(near_dedup.shingles(text), a, b).reshape(36, 4)
    one, other = map(sign, copies)
    runs = [" ".join(passage[i : i + 5]) for i in range(56)]
    of_run = np.stack([sign(r) for r in runs])
    rows = []
    for band in np.flatnonzero((one == other).all(axis=1)):
        held = sorted({int(np.flatnonzero(of_run[:, band, k] == one[band, k])[0]) for k in range(4)})
        for seed in range(20_000):
            text = " ".join(f"{runs[i]} q{band}x{seed}y{i}" for i in held)
            if (sign(text)[band] == one[band]).all():
                break
        assert (sign(text)[band] == one[band]).all() and (sign(text) == one).mean() < 0.5
        rows.append((int(band), text))
    rows += [(900 + i, t) for i, t in enumerate(copies)]
    want = brute_components(rows)
    assert (901, 61, 900) in want
    assert by_row(near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")), "doc_id", "n_shingles", "component_id") == want


def letters(n, pairs, seed=3):
    """Letters of 40 clauses in two wordings each, and near copies of the first ones."""
    rng = np.random.default_rng(seed)
    clauses = [[" ".join(f"{'ab'[v]}{c}w{k}" for k in range(6)) for v in range(2)] for c in range(40)]
    rows = [(1000 + i, " ".join(clauses[c][v] for c, v in enumerate(rng.integers(0, 2, 40)))) for i in range(n)]
    for i in range(pairs):
        w = rows[i * 7 % n][1].split()
        for k in rng.choice(240, 1 + i % 5, replace=False):
            w[k] = f"z{i}k{k}"
        rows.append((1000 + n + i, " ".join(w)))
    return rows


def links_by_matrix(rows, threshold=75):
    """Components of the links of texts with five words or more, from an incidence matrix."""
    number, at = {}, []
    for _, t in rows:
        w = t.split()
        at.append(sorted({number.setdefault(tuple(w[k : k + 5]), len(number)) for k in range(len(w) - 4)}))
    m = np.zeros((len(rows), len(number)), np.float32)
    for i, x in enumerate(at):
        m[i, x] = 1
    shared, size = m @ m.T, m.sum(axis=1)
    linked = 100 * shared >= threshold * (size[:, None] + size[None, :] - shared)
    label = np.array([i for i, _ in rows])
    while True:
        new = np.where(linked, label[None, :], 1 << 60).min(axis=1)
        if (new == label).all():
            return sorted(zip([i for i, _ in rows], label.tolist()))
        label = new


@pytest.mark.parametrize("n, pairs, block, wide", [(3000, 100, 512, 8), (400, 60, 8, 1)])
def test_near_dedup_of_letters_in_two_wordings(spark, n, pairs, block, wide):
    """Buckets hold many letters unlike each other; near copies are found all the same, in wide buckets too."""
    rows = letters(n, pairs)
    want = links_by_matrix(rows)
    assert sum(i != c for i, c in want) >= 0.9 * pairs
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert by_row(near_dedup.near_duplicates(df, block=block, meet=block, wide=wide), "doc_id", "component_id") == want


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 40)] + [(100, 101), (101, 100), (7, 7), (None, 3)], "a long, b long")
    got = {r["node"]: r["component"] for r in connected_components(edges, "a", "b").collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}
    assert connected_components(edges.limit(0), "a", "b").count() == 0


def test_toxicity(docs, empty, spark):
    rng = np.random.default_rng(1)
    insults = ["grumblefool", "grumblewit", "snarkhead"]
    rows, labels = [], []
    for i in range(600):
        bad = i % 6 == 0
        w = list(rng.choice(WORDS, 40)) + ([str(rng.choice(insults))] * 2 if bad else [])
        rows.append((i, " ".join(rng.permutation(w))))
        labels.append((i, int(bad)))
    labels += [(1, None), (5000, 1)]
    labels = spark.createDataFrame(labels, "doc_id long, toxic int")
    out = toxicity.score_toxicity(spark.createDataFrame(rows, "doc_id long, text string"), labels).where("held_out").collect()
    assert all(r["predicted"] == int(r["doc_id"] % 6 == 0) for r in out) and len(out) > 100
    assert {r["doc_id"] for r in out} == {i for i, _ in rows if zlib.crc32(str(i).encode()) % 4 == 2}
    odd = toxicity.score_toxicity(docs, labels)
    assert odd.count() == len(TEXTS) and odd.where("score is null or score < 0 or score > 1").count() == 0
    assert toxicity.score_toxicity(docs, labels.limit(0)).where("score <> 0").count() == 0
    assert toxicity.score_toxicity(empty, labels).count() == 0


def test_toxicity_risk_and_direction():
    rng = np.random.default_rng(3)
    for shift in (0.0, 6.0):  # the bracket above and below zero
        fp, fu, prior, step = rng.normal(size=5) + shift, rng.normal(size=9) - shift, 0.3, 1e-6
        positive = lambda f: np.log1p(np.exp(-f)).mean()
        bracket = lambda p, u: positive(-u) - prior * positive(-p)
        value, gp, gu = toxicity.risk(fp, fu, prior)
        below = bracket(fp, fu) < 0
        assert below == (shift > 0) and value == pytest.approx(prior * positive(fp) + max(0, bracket(fp, fu)))
        goal = (lambda p, u: -bracket(p, u)) if below else lambda p, u: prior * positive(p) + bracket(p, u)
        for x, g, at in ((fp, gp, 0), (fu, gu, 1)):
            for i in range(len(x)):
                up = [fp.copy(), fu.copy()]
                up[at][i] += step
                assert (goal(*up) - goal(fp, fu)) / step == pytest.approx(g[i], abs=1e-5)


def test_toxicity_features_do_not_depend_on_where_a_slice_ends(monkeypatch):
    texts = [" ".join(f"wort{i % 97}ñé" for i in range(3000)), "x" * 400 + " ende " + "y" * 401, "", None]
    whole = [toxicity.features(t) for t in texts]
    monkeypatch.setattr(toxicity, "SLICE", 401)
    for n, (t, w) in enumerate(zip(texts, whole)):
        got = toxicity.features(t)
        if n != 1:
            assert got.tolist() == w.tolist()
    short = toxicity.features("y" * 401)
    assert len(toxicity.features("y" * 402)) == len(short) == 3


def brute_nearest(rows, k, asks):
    good = {i: np.array(v, float) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v) and len(v) == 8}
    out = []
    for q in filter(asks, good):
        score = sorted((-float(good[q] @ v / np.sqrt((good[q] @ good[q]) * (v @ v))), i) for i, v in good.items() if i != q)[:k]
        out += [(q, r, i) for r, (_, i) in enumerate(score, 1)]
    return sorted(out, key=repr)


def test_nearest(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(300)]
    rows += [(1000, None), (1001, [0.0] * 8), (1002, [1.0, None] * 4), (1003, [float("nan")] * 8), (1004, [1.0] * 3), (None, [1.0] * 8), (1005, [float("inf")] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for block, query_block in ((8192, 512), (64, 3)):
        got = ann.nearest(df, F.col("vec_id") % 50 == 0, block=block, query_block=query_block)
        assert by_row(got, "query_id", "rank", "vec_id") == brute_nearest(rows, 5, lambda i: i % 50 == 0)
    assert ann.nearest(df.limit(0), F.lit(True)).count() == 0


def test_nearest_breaks_ties_and_takes_few(spark):
    df = spark.createDataFrame([(i, [1.0, 2.0]) for i in (0, 9, 4, 7)], "vec_id long, embedding array<float>")
    assert by_row(ann.nearest(df, F.col("vec_id") == 0), "rank", "vec_id") == [(1, 4), (2, 7), (3, 9)]


def test_nearest_counts_an_id_once_and_takes_any_magnitude(spark):
    rows = [(0, [1.0, 2.0]), *[(1, [1.0, 2.1])] * 9, (2, [1e200, 2e200]), (3, [1e-310, 2.2e-310]), (4, [2.0, 1.0]), (4, [1.0, 2.0]), (5, [-1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = ann.nearest(df, F.col("vec_id") == 0).collect()
    assert [(r["rank"], r["vec_id"]) for r in sorted(got, key=lambda r: r["rank"])] == [(1, 2), (2, 4), (3, 1), (4, 3), (5, 5)]
    assert {r["vec_id"]: round(r["score"], 9) for r in got}[2] == 1.0


def test_packed_products_are_those_of_the_rounded_query():
    rng = np.random.default_rng(2)
    for d in (5, 64, 100):
        bits, rest = rng.random((50, d)) > 0.5, rng.normal(size=d)
        codes = ann._packed(bits)
        plane, low, step, rounded = ann.planes(rest)
        assert np.abs(rounded - rest).max() <= step / 2 + 1e-12
        got = ann._products(codes, bits.sum(axis=1), plane, low, step, rounded)
        assert np.allclose(got, (2.0 * bits - 1) @ rounded)


def _coded(ids, v, mean, turn):
    bits, far, inner = ann.encode(v, mean, turn)
    return pa.table({"id": ids, "v": pa.array(list(v)), "code": [b.tobytes() for b in bits], "far": far, "inner": inner})


def test_search_measures_few_pairs_exactly(monkeypatch):
    """At 64 dimensions the codes let through two pairs of five; each of them was measured in double precision, a query at a time."""
    rng = np.random.default_rng(8)
    v = rng.normal(size=(6000, 64))
    v[3000:3040] = v[5]  # ties, which go by id
    ids, asked = rng.permutation(6000), [3, 5, 3007, *range(40, 75)]
    mean, turn, measured, cosines = np.zeros(64), ann.rotation(64), [], ann._cosines
    monkeypatch.setattr(ann, "_cosines", lambda c, q: measured.append(c.shape[1]) or cosines(c, q))
    queries = pa.table({"id": ids[asked], "v": pa.array(list(v[asked]))})
    got = ann._search(queries, _coded(ids, v, mean, turn), 5, 64, mean, turn, 4.5).to_pydict()
    assert sum(measured) < 0.05 * len(asked) * len(ids)
    found = {}
    for q, i in sorted(zip(got["query_id"], zip(-np.array(got["score"]), got["id"]))):
        found.setdefault(q, []).append(i[1])
    for n in asked:
        score = np.round(v @ v[n] / np.linalg.norm(v, axis=1) / np.linalg.norm(v[n]), 12)
        assert found[ids[n]] == [ids[j] for j in np.lexsort((ids, -score)) if j != n][:5]


def test_bounds_are_those_of_the_codes_and_hardly_wider():
    rng = np.random.default_rng(9)
    for d in (3, 64, 100):
        v, q = rng.normal(size=(50, d)) + 0.3, rng.normal(size=(7, d))
        v[7] = q[2]
        mean, turn = ann._unit(v).mean(axis=0), ann.rotation(d)
        bits, far, inner = ann.encode(v, mean, turn)
        rest = (ann._unit(q) - mean) @ turn
        got = ann._Bounds(bits, far, inner, rest, 4.5)(slice(0, 7), slice(0, 50))
        for x, found in zip(rest, got):
            plane, low, step, rounded = ann.planes(x)
            estimate = ann._products(bits, np.bitwise_count(bits).sum(axis=1, dtype=np.int64), plane, low, step, rounded) / (d**0.5 * inner)
            middle = 1 - (far**2 + x @ x) / 2 + far * estimate
            wide = 4.5 * far * np.sqrt((1 - np.minimum(inner, 1) ** 2) / inner**2 / (d - 1) * (x @ x) + ((x - rounded) ** 2).sum() / (d * inner**2))
            assert (found >= middle + wide).all() and (found <= middle + 1.05 * wide + 2e-4).all()


def test_pairs_that_codes_let_through_are_found_few_or_many():
    rng = np.random.default_rng(10)
    u, c = (ann._unit(rng.normal(size=(n, 8))).astype(np.float32) for n in (6, 400))
    for share in (0.01, 0.9):
        let = rng.random((6, 400)) < share
        row, at = ann._passing(u, c, let, np.full(6, 0.2, np.float32))
        assert list(zip(row, at)) == [(i, j) for i, j in zip(*np.nonzero(let)) if u[i] @ c[j] >= 0.2]


def test_a_small_table_is_searched_in_several_blocks(spark, monkeypatch):
    """Up to 65,536 rows were one group, so one task had all the work."""
    rows = spark.range(8192).select(F.col("id").alias("vec_id"), F.array(F.randn(1), F.randn(2)).alias("embedding"))
    seen, kept = [], ann.stored
    monkeypatch.setattr(ann, "stored", lambda df: seen.append(df._jdf.queryExecution().analyzed().toString()) or kept(df))
    assert ann.nearest(rows, F.col("vec_id") % 1000 == 0).count() == 45
    assert re.findall(r"pmod\(xxhash64\(id#\d+L, 42\), cast\((\d+) as bigint\)\)", seen[0]) == ["4"]


def test_recall_at_many_dimensions(spark):
    rng = np.random.default_rng(6)
    v = {i: x for i, x in enumerate(rng.normal(size=(2000, 64)))}
    df = spark.createDataFrame([(i, x.tolist()) for i, x in v.items()], "vec_id long, embedding array<double>")
    got = {(r["query_id"], r["vec_id"]) for r in ann.nearest(df, F.col("vec_id") % 50 == 0).collect()}
    m = np.stack(list(v.values()))
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    want = set()
    for q in range(0, 2000, 50):
        s = m @ m[q]
        s[q] = -2
        want |= {(q, int(i)) for i in np.argsort(-s)[:5]}
    assert len(got & want) >= 0.99 * len(want)


def test_pipeline_stages(spark, tmp_path):
    rows = [(i, f"{t} {prose(70 + i, 15)}") for i, t in enumerate([prose(1, 80), prose(1, 80), prose(2, 90)])]
    rows += [(10 + i, prose(500 + i, 60) + (" grumblefool grumblefool" if i % 5 == 0 else "")) for i in range(200)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(10 + i, 1, int(i % 5 == 0)) for i in range(200)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    now, kept = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, str(tmp_path)).cache()
        kept[name] = {r["doc_id"] for r in now.collect()}
        if name != "packing":
            assert now.columns == docs.columns and now.where("n_chars <> length(text)").count() == 0
    assert kept["toxicity"] == {i for i, t in rows if "grumblefool" not in t}
    assert kept["line_dedup"] == kept["toxicity"]
    assert kept["near_dedup"] == {i for i, _, c in brute_components([r for r in rows if r[0] in kept["line_dedup"]]) if i == c}
    assert kept["packing"] == kept["substring_dedup"] == kept["near_dedup"]
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(kept["packing"])


@pytest.mark.parametrize("name", [n for n in queries.ORACLES])
def test_same_rows_as_sql(spark, name):
    from tests.oracle import assert_same, connect

    small = "/root/testdata/sf0.001"
    assert_same(queries.QUERIES[name](spark, small), connect(small), queries.ORACLES[name])


def test_words_pattern():
    assert [w for w in re.split(license_scan.SEPARATORS, "a-b_c 1é") if w] == ["a", "b", "c", "1é"]
