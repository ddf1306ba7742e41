"""Nothing is cut or mixed up as tables grow: each operator against a plain computation where a bounded table or candidate list would show."""

import math
import random
from collections import Counter

import numpy as np
import pytest

from polymodal import search
from polymodal.llm import ann, lm_scoring, simhash


def test_every_word_and_bigram_has_counts_of_its_own(spark):
    rng = random.Random(1)
    texts = [" ".join(f"w{rng.randrange(400_000)}" for _ in range(2000)) for _ in range(200)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    words = [t.split() for t in texts]
    assert len({w for ws in words for w in ws}) > 250_000
    rows = {r["doc_id"]: r for r in lm_scoring.cross_entropy_difference(docs, docs.where("doc_id % 10 = 0").select("doc_id")).collect()}
    assert len(rows) == 200
    want = plain_losses(words, {i for i in range(200) if i % 10 == 0})
    for i in range(200):
        assert (rows[i]["ce_target"], rows[i]["ce_background"]) == pytest.approx(want[i], rel=1e-9)


def plain_losses(words, targets):
    """(target, background) losses of each list of words by Counters of words and pairs, its own counts left out."""

    def counts(texts):
        return Counter(w for ws in texts for w in ws), Counter(v for ws in texts if ws for v in ["", *ws[:-1]]), Counter(p for ws in texts for p in zip(["", *ws[:-1]], ws))

    every, chosen = counts(words), counts([ws for i, ws in enumerate(words) if i in targets])
    vocabulary = len(every[0]) + 1
    n_every, n_chosen = sum(every[0].values()), sum(chosen[0].values())
    out = []
    for i, ws in enumerate(words):
        if not ws or not n_chosen:
            out.append((None, None))
            continue
        own, none = counts([ws]), (Counter(), Counter(), Counter())
        size = max(n_every - len(ws), 1)
        losses = []
        for corpus, less, total, scale in ((chosen, own if i in targets else none, n_chosen - (len(ws) if i in targets else 0), 1.0), (every, own, size, n_chosen / size)):
            loss = 0
            for v, w in zip(["", *ws[:-1]], ws):
                word, context, pair = ((c[k] - x[k]) * scale for c, x, k in zip(corpus, less, (w, v, (v, w))))
                p = (word + lm_scoring.BEFOREHAND) / (total * scale + lm_scoring.BEFOREHAND * vocabulary)
                loss -= math.log((pair + lm_scoring.BACK_OFF * p) / (context + lm_scoring.BACK_OFF)) / len(ws)
            losses.append(loss)
        out.append(tuple(losses))
    return out


def test_all_rows_score_as_plain_counts_do(spark, sf):
    table = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet").where("quality = 1 and toxic = 0").select("doc_id")
    texts = {r["doc_id"]: (r["text"] or "").encode().lower().split() for r in table.collect()}
    ids = sorted(texts)
    targets = {r["doc_id"] for r in labels.collect()}
    want = plain_losses([[w.decode() for w in texts[i]] for i in ids], {k for k, i in enumerate(ids) if i in targets})
    got = {r["doc_id"]: r for r in lm_scoring.cross_entropy_difference(table, labels).collect()}
    for i, (target, background) in zip(ids, want):
        r = got[i]
        assert (r["n_tokens"], r["in_target"]) == (len(texts[i]), i in targets)
        if target is None:
            assert r["score"] is None
        else:
            assert (r["ce_target"], r["ce_background"], r["score"]) == pytest.approx((target, background, target - background), rel=1e-9, abs=1e-9)


def test_probabilities_sum_to_one():
    rng = random.Random(2)
    text = [rng.choice("abcdefg") for _ in range(500)]
    word, context, pair = Counter(text), Counter(["", *text[:-1]]), Counter(zip(["", *text[:-1]], text))
    vocabulary = len(word) + 1
    for v in ["", *"abcdefg", "never"]:
        for scale in (1.0, 0.37):
            counts = np.array([[x[k] for k in keys] for x, keys in ((word, [*"abcdefg", "?"]), (context, [v] * 8), (pair, [(v, w) for w in "abcdefg?"]))], float)
            total = lm_scoring.probability(counts, 500, scale, vocabulary).sum()
            assert total == pytest.approx(1, abs=1e-12)


def test_keys_and_counts_come_back_as_they_were():
    rng = np.random.default_rng(3)
    keys = np.unique(np.concatenate([rng.integers(0, 2**64, 5000, np.uint64), np.array([0, 1, 2**64 - 1], np.uint64)]))
    assert np.array_equal(lm_scoring._unfolded(lm_scoring._folded(keys), len(keys)), keys)
    for top in (2, 300, 70_000, 2**40):
        n = rng.integers(0, top, 50)
        assert np.array_equal(lm_scoring._unpacked(lm_scoring._packed(n), 50), n)


@pytest.mark.parametrize("metric", ["ip", "l2"])
def test_copies_beyond_the_rerank_go_to_smaller_ids(spark, metric):
    """A third of all rows are copies of one vector: the smallest ids must be among the hits."""
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 16)).astype(np.float32)
    x[rng.permutation(3000)[:1000]] = v = (3 * rng.normal(size=16)).astype(np.float32)
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)] + [(100000, v.tolist())], "vec_id long, embedding array<float>")
    got = [r["vec_id"] for r in ann.nearest(df, df["vec_id"] == 100000, metric=metric).orderBy("rank").collect()]
    s = ann.exact_scores(v, x) if metric == "ip" else -np.sqrt(((v.astype(np.float64) - x) ** 2).sum(1))
    assert got == np.lexsort((np.arange(3000), -s))[:20].tolist()


def test_recall_where_few_are_reranked(spark):
    """12,000 rows of 32 dimensions in clusters, doubles: under 2% of them are scored exactly."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(60, 32))
    x = centres[rng.integers(0, 60, 12000)] + 0.4 * rng.normal(size=(12000, 32))
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    assert ann.RERANK / 12000 < 0.02
    for metric in ("ip", "l2"):
        hits = 0
        rows = ann.nearest(df, df["vec_id"] % 100 == 0, metric=metric).collect()
        for q in range(0, 12000, 100):
            s = x @ x[q] if metric == "ip" else -((x - x[q]) ** 2).sum(1)
            s[q] = -np.inf
            hits += len(set(np.argsort(-s)[:20].tolist()) & {r["vec_id"] for r in rows if r["query_id"] == q})
        assert hits / (20 * 120) >= 0.9
        if metric == "ip":
            assert all(r["score"] == float((x[r["query_id"]] * x[r["vec_id"]]).sum()) for r in rows[:50])


@pytest.mark.parametrize("metric", ["ip", "l2"])
def test_recall_on_rows_without_structure(spark, metric):
    """10,000 rows of 100 dimensions in no clusters, a fifth of them outside the sample, and lengths that differ: codes of one length for all dimensions miss most."""
    rng = np.random.default_rng(11)
    x = rng.normal(size=(10000, 100)) * rng.uniform(0.9, 1.1, size=(10000, 1))
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    rows, hits = ann.nearest(df, df["vec_id"] % 100 == 0, metric=metric).collect(), 0
    for q in range(0, 10000, 100):
        s = x @ x[q] if metric == "ip" else -((x - x[q]) ** 2).sum(1)
        s[q] = -np.inf
        hits += len(set(np.argsort(-s)[:20].tolist()) & {r["vec_id"] for r in rows if r["query_id"] == q})
    assert hits / (20 * 100) >= 0.99


def test_margins_hold_what_estimates_miss():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(600, 20))
    norm, unit = ann._lengths(x)
    books = ann.train(unit, words=32, fine=2)
    codes, q = ann.encode(unit, books), rng.normal(size=(9, 20))
    for metric, truth in (("ip", ann._lengths(q)[1] @ x.T), ("l2", 2 * q @ x.T - norm * norm)):
        off = np.abs(ann.estimates(q, codes, norm, books, metric) - truth)
        assert (off <= ann.margins(q, norm, ann.residuals(unit, codes, books), 1.0, metric)).all()
    assert 0 < ann.error_share(q, unit, books) <= 1


def test_threshold_search_has_no_limit(spark, sf):
    from polymodal.queries.search import CASES

    plan = CASES["vector_threshold"][0](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "Limit" not in plan and "Window" not in plan
    df = spark.createDataFrame([(i, [float(i)]) for i in range(50)], "id long, v array<float>")
    assert {r["id"] for r in search.top_k_hits(df, "v", [0.0], None, distance_threshold=40.0).collect()} == set(range(41))


def test_near_copies_of_similar_texts_go(spark):
    rng = random.Random(4)

    def changed(ws, n):
        ws = list(ws)
        for k in range(n):
            ws[(k * 37 + 11) % len(ws)] = f"new{rng.random()}"
        return " ".join(ws)

    texts = []
    for g in range(20):
        ws = [f"w{rng.randrange(5000)}" for _ in range(200)]
        texts += [" ".join(ws), changed(ws, 3), changed(ws, 12)]  # similarities to the first about 0.86 and 0.53
    docs = spark.createDataFrame([*enumerate(texts), (100, None), (101, " "), (102, "one"), (103, "ONE")], "doc_id long, text string")
    assert {r["doc_id"] for r in simhash.one_of_each(docs).collect()} == {i for i in range(60) if i % 3 != 1} | {100, 102}


def similar(a, b):
    a, b = (set(zip(*(t.lower().split()[k:] for k in range(5)))) or {tuple(t.lower().split())} for t in (a, b))
    return len(a & b) / len(a | b)


def test_near_copies_match_all_pairs(spark):
    """Components of all pairs of similarity 0.8 or more, in a table with a large group, chains and equal texts."""
    rng = random.Random(11)
    base = [[f"w{rng.randrange(3000)}" for _ in range(rng.randrange(60, 200))] for _ in range(40)]
    texts = []
    for k, ws in enumerate(base):
        for _ in range(150 if k == 0 else rng.randrange(1, 5)):
            ws = list(ws)
            for _ in range(rng.randrange(3)):
                ws[rng.randrange(len(ws))] = f"n{rng.randrange(10**6)}"
            texts.append(" ".join(ws))
    texts += texts[:5]
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if similar(texts[i], texts[j]) >= 0.8:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    docs = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_copies(docs).collect()}
    want = {i: root(i) for i in range(len(texts))}
    assert sum(got[i] != want[i] for i in got) <= 0.02 * len(texts) and set(got) == set(want)
    assert all(want[got[i]] == want[i] for i in got)  # nothing is linked that is not similar


@pytest.mark.parametrize("n", [1, 30, 700])
def test_least_forest_keeps_components_at_every_distance(n):
    rng = np.random.default_rng(n)
    i, j = rng.integers(0, n, 3 * n), rng.integers(0, n, 3 * n)
    far = rng.integers(0, 20, 3 * n)
    kept = simhash.least_forest(i, j, far, n)
    for most in (0, 5, 19):
        every, some = simhash.Forest(n), simhash.Forest(n)
        every.link(i[far <= most], j[far <= most])
        own = kept[far[kept] <= most]
        some.link(i[own], j[own])
        assert np.array_equal(every.parent, some.parent)
    assert len(kept) < n
