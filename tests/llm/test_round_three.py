"""MinHash near duplicates, whitening and ranked search: brute force, edge cases, and that their methods do the work."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from test_llm_helpers import all_pairs
from test_text_operators import near_copies

from gridloom.llm import lexical, minhash, whitening
from gridloom.llm.lexical import SearchSettings
from gridloom.llm.minhash import MinHashSettings
from gridloom.llm.queries import QUERIES

# --- MinHash ---------------------------------------------------------------------------------------------


def test_op11(spark, small_dir, small_docs):
    rows = QUERIES["op11_minhash"](spark, small_dir).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == all_pairs(small_docs, 2, 80)
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows)


@pytest.mark.parametrize("words", [2, 5])
def test_minhash_components_of_a_large_group(frame, words):
    rows = near_copies(words, 90)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(frame(rows), MinHashSettings(words=words)).collect()}
    assert got == all_pairs(dict(rows), words, 80)


def test_minhash_buckets_without_links_go_on_to_pairs(frame):
    # All texts share buckets with the smallest id, none is similar to it, and two later ones are to each other.
    rnd = random.Random(3)
    base = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(base + [f"x{rnd.randrange(10**6)}" for _ in range(24)])) for i in range(40)]
    rows += [(100, rows[20][1] + " more"), (101, rows[30][1] + " words here")]
    settings = MinHashSettings(words=1, bands=60, rows=1)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(frame(rows), settings).collect()}
    assert got == all_pairs(dict(rows), 1, 80)
    assert got[100][1] == 20 and got[101][1] == 30


def test_minhash_edge_cases(frame):
    same = "one two three four five six seven"
    rows = [(3, same), (1, same.upper() + "\n"), (2, None), (4, ""), (5, " \t"), (6, "one two"), (7, "One  TWO"), (None, same), (8, "x" * 300_000), (8, "x" * 300_000)]
    got = [(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(frame(rows)).collect()]
    want = [(3, 3, 1, False), (1, 3, 1, True), (2, 0, 2, True), (4, 0, 4, True), (5, 0, 5, True), (6, 1, 6, True), (7, 1, 6, False)]
    assert sorted(got, key=str) == sorted([*want, (None, 3, None, True), (8, 1, 8, True), (8, 1, 8, True)], key=str)
    kept = minhash.keep_one_of_each(frame(rows))
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted([1, 2, 4, 5, 6, None, 8, 8], key=str)
    assert kept.columns == frame(rows).columns
    assert minhash.near_duplicates(frame([])).count() == 0


def test_densified_bins_agree_as_often_as_sets_are_similar():
    rnd, bins = np.random.default_rng(1), 160
    ranks = minhash.probe_ranks(bins, 5)
    for n in (5, 20, 400):  # far fewer tokens than bins, and more
        agree = []
        for _ in range(300):
            a = rnd.integers(0, 2**63, n + n // 4).astype(np.uint64)
            x, y = minhash.signature(a[:n], bins, ranks), minhash.signature(a, bins, ranks)
            agree.append((x == y).mean())
        assert abs(np.mean(agree) - n / (n + n // 4)) < 0.03


# --- whitening -------------------------------------------------------------------------------------------


def plain_whitening(vectors):
    x = np.floor(256 * np.array(vectors, dtype=float)).astype(np.int64)
    fit = np.unique(x, axis=0)
    n, total = len(fit), fit.sum(axis=0)
    centred = fit - total / n
    cov = centred.T @ centred / n
    values, axes = np.linalg.eigh(cov)
    return x, n, total, values[::-1], axes[:, ::-1], np.trace(cov)


def test_op12(spark, small_dir):
    rows = {(r.vec_id, r.component): r for r in QUERIES["op12_whitening"](spark, small_dir).collect()}
    given = spark.read.parquet(f"{small_dir}/embeddings.parquet").collect()
    x, n, total, values, axes, trace = plain_whitening([r.embedding for r in given])
    assert set(rows) == {(r.vec_id, k) for r in given for k in (1, 2, 3, 4)}
    signs = {}
    for row, own in zip(given, x):
        z = (own - total / n) @ axes[:, :4] / np.sqrt(values[:4])
        for k in (1, 2, 3, 4):
            r = rows[row.vec_id, k]
            assert r.n == n and r.deviation == sum((n * int(a) - int(s)) ** 2 for a, s in zip(own, total))
            assert math.isclose(r.explained, values[k - 1] / trace, rel_tol=1e-9) and r.identity_error < 1e-9
            sign = signs.setdefault(k, math.copysign(1, r.whitened * z[k - 1]))
            assert math.isclose(r.whitened, sign * z[k - 1], abs_tol=1e-9)


SCHEMA = "vec_id BIGINT, embedding ARRAY<FLOAT>, row STRING, x INT, n INT, whitened STRING"


def vectors_frame(spark, vectors):
    return spark.createDataFrame([(i, v, "r", 1, 2, "w") for i, v in enumerate(vectors)], SCHEMA)


def test_whitening_drops_unusable_rows_and_counts_copies_once(spark):
    good = np.random.default_rng(2).normal(size=(40, 3)) * [4, 2, 1]
    given = [*good.tolist(), *good[:5].tolist(), None, [], [1.0, None, 2.0], [1.0, float("nan"), 0.0], [float("inf"), 0.0, 0.0], [1.0, 2.0], [3e38, 0.0, 0.0]]
    out = {r.row.vec_id: r for r in whitening.whiten(vectors_frame(spark, given), components=4).collect()}
    assert set(out) == set(range(45)) and out[0].n == 40 and out[0].row.row == "r"
    assert all(out[k].whitened == out[40 + k].whitened and out[k].deviation == out[40 + k].deviation for k in range(5))
    x, n, total, values, axes, trace = plain_whitening(np.array(good, np.float32))
    z = (x[:40] - total / n) @ axes / np.sqrt(values)
    assert np.allclose(np.abs(np.array([out[i].whitened for i in range(40)])), np.abs(z), atol=1e-9)
    assert np.allclose(out[0].explained, values / trace)


def test_whitening_of_equal_variances_and_missing_directions(spark):
    # Two equal leading variances, which one Krylov space can't tell apart, and a dimension without any variance.
    corners = [[a, b, c, 1.0] for a in (-2.0, 2.0) for b in (-2.0, 2.0) for c in (-1.0, 1.0)]
    out = whitening.whiten(vectors_frame(spark, corners)).collect()
    explained = out[0].explained
    assert np.allclose(explained, [4 / 9, 4 / 9, 1 / 9, 0]) and out[0].identity_error < 1e-12
    z = np.array([r.whitened[:3] for r in out], float)
    assert np.allclose(z.T @ z / len(z), np.eye(3)) and all(r.whitened[3] is None for r in out)


def test_whitening_edge_cases(spark):
    assert whitening.whiten(vectors_frame(spark, [])).count() == 0
    assert whitening.whiten(vectors_frame(spark, [None, []])).count() == 0
    one = whitening.whiten(vectors_frame(spark, [[0.5, 0.25]] * 3)).collect()
    assert [(r.n, int(r.deviation), r.whitened, r.explained, r.identity_error) for r in one] == [(1, 0, [None, None], [None, None], None)] * 3


# --- ranked search ---------------------------------------------------------------------------------------

TERMS = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
FOLD = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def terms_of(text):
    return [t.translate(FOLD) for t in TERMS.findall(text or "")]


def plain_search(docs, items, top=10):
    """``{item: [(doc, score)]}`` from lists of rows."""
    bags = [(i, Counter(terms_of(t))) for i, t in docs]
    sizes = [sum(b.values()) for _, b in bags]
    whole, total = sum(s > 0 for s in sizes), sum(sizes)
    df = Counter(t for _, b in bags for t in b)
    out = {}
    for item in {i for i, _ in items}:
        wanted = {t for i, text in items if i == item for t in terms_of(text)}
        scored = []
        for (doc, bag), n in zip(bags, sizes):
            score = 0
            for t in wanted & bag.keys():
                m = 10 + 90 * n * whole // total
                w = math.floor(1000 * math.log((2 * whole + 2) / (2 * df[t] + 1)))
                score += w * (1_000_000_000 * bag[t] // (1000 * bag[t] + 8 * m))
            if score > 0 and doc is not None:
                scored.append((-score, doc))
        out[item] = [(doc, -s) for s, doc in sorted(scored)[:top]]
    return {k: v for k, v in out.items() if v}


def by_item(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (str(r.item_id), r.rank)):
        out.setdefault(r.item_id, []).append((r.doc_id, r.score))
        assert r.rank == len(out[r.item_id])
    return out


def made_corpus(seed, n=400):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    rows = [(i, " ".join(words[min(299, int(rnd.expovariate(0.02)))] for _ in range(rnd.randrange(1, 60)))) for i in range(n)]
    items = [(k, " ".join(rnd.sample(words, 8))) for k in range(12)]
    return rows, items


def items_frame(spark, items):
    return spark.createDataFrame([(i, t, "x", 0) for i, t in items], "item_id BIGINT, text STRING, doc_id STRING, score INT")


@pytest.mark.parametrize("s", [SearchSettings(), SearchSettings(chunk_rows=64, pivots=8, sample_rows=50, pairs_per_pass=30), SearchSettings(top=3, sample_rows=1)])
def test_search_finds_what_scoring_all_finds(spark, frame, s):
    rows, items = made_corpus(7)
    got = by_item(lexical.search(frame(rows), items_frame(spark, items), s).collect())
    assert got == plain_search(rows, items, s.top)


def test_search_edge_cases(spark, frame):
    rows = [(1, "Alpha beta"), (2, "alpha BETA"), (2, "alpha beta"), (3, None), (4, ""), (5, "ÄÖ été 中文 x_y"), (None, "alpha alpha"), (6, ("beta " * 80_000) + "alpha" * 90_000)]
    items = [(1, "alpha, beta!"), (2, "été 中文 Y"), (3, "nowhere"), (4, None), (5, "?!"), (1, "gamma"), (None, "alpha")]
    got = by_item(lexical.search(frame(rows), items_frame(spark, items)).collect())
    assert got == plain_search(rows, items)
    assert [d for d, _ in got[1]][:3] == [1, 2, 2] and set(got) == {1, 2, None}
    assert lexical.search(frame([]), items_frame(spark, items)).count() == 0
    assert lexical.search(frame(rows), items_frame(spark, [])).count() == 0


def test_blocks_are_skipped_by_their_bounds_alone(monkeypatch):
    """Blocks cover each posting list once, bounds hold for all their documents, and most blocks are not scored."""
    rnd = np.random.default_rng(4)
    topics = rnd.random((50, 20)) < 0.2  # documents of a topic hold most of its terms and few others
    held = rnd.random((50, 600)) < np.where(np.repeat(topics, 30, axis=1), 0.8, 0.02)
    impacts = np.where(held, rnd.integers(500, 1000, (50, 600)), 0).astype(np.int32)
    weights = rnd.integers(1, 9000, 50).astype(float)
    chunk = lexical.Chunk(impacts, np.arange(600), weights, 32)
    own = np.flatnonzero(topics[:, 3])  # an item about one topic
    for t in own:
        listed, starts = chunk.blocks(t)
        assert sorted(listed) == sorted(np.flatnonzero(impacts[t]))
        bounds = weights[own] @ chunk.summary(own, listed, starts)
        for a, b, bound in zip(starts, np.append(starts[1:], len(listed)), bounds):
            assert (chunk.scores(own, listed[a:b]) <= bound).all()
    scored = []
    plain = lexical.Chunk.scores
    monkeypatch.setattr(lexical.Chunk, "scores", lambda self, terms, places: scored.append(len(places)) or plain(self, terms, places))
    floor = np.sort(plain(chunk, own, np.arange(600)))[-10]
    best = lexical.Best(np.array([floor]), 10)
    chunk.search([own], best)
    everything = lexical.Best(np.ones(1), 10)
    chunk.search_all([own], everything)
    assert best.docs[0].tolist() == everything.docs[0].tolist() and best.scores[0].tolist() == everything.scores[0].tolist()
    assert sum(scored[:-1]) < 300


def test_search_takes_the_smaller_id_of_equal_scores(spark, frame):
    rows = [(i, "same words here") for i in range(50, 0, -1)]
    got = by_item(lexical.search(frame(rows), items_frame(spark, [(1, "words")]), SearchSettings(sample_rows=5)).collect())
    assert [d for d, _ in got[1]] == list(range(1, 11))
