import random

import numpy as np
import pyarrow as pa
import pytest
from conftest import SF_SMALL
from inclusio.llm import near_dup as nd
from inclusio.llm.components import connected_components
from inclusio.llm.vectext import Words, buffers, shingle_ids

from .conftest import prose


def sets_of(texts):
    out = []
    for t in texts:
        offs, data = buffers(pa.array([t]))
        first, ids, counts = shingle_ids(Words(data, offs))
        out.append((ids, counts))
    return out


def brute_classes(texts, idf, threshold=0.8):
    """Union of equal texts and of all pairs whose plain or weighted similarity reaches the threshold."""
    up = list(range(len(texts)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    sets = sets_of(texts)
    for i in range(len(texts)):
        for j in range(i):
            (a, ca), (b, cb) = sets[i], sets[j]
            link = texts[i] == texts[j]
            if not link and len(a) and len(b):
                both, x, y = np.intersect1d(a, b, return_indices=True)
                wa, wb = nd._weights(a, ca, idf), nd._weights(b, cb, idf)
                low = np.minimum(wa[x], wb[y]).sum()
                link = max(len(both) / (len(a) + len(b) - len(both)), low / (wa.sum() + wb.sum() - low)) >= threshold
            if link:
                up[max(top(i), top(j))] = min(top(i), top(j))
    return [top(i) for i in range(len(texts))]


def check(spark, docs):
    rows = sorted((r.doc_id, r.text or "") for r in docs.collect())
    idf = nd.cell_weights(docs)
    want = brute_classes([t for _, t in rows], idf)
    got = {r.doc_id: r for r in nd.near_duplicates(docs).collect()}
    assert {d: got[d].class_id for d, _ in rows} == {d: rows[c][0] for (d, _), c in zip(rows, want)}
    for d, _ in rows:
        assert got[d].kept == (got[d].class_id == d)
        assert got[d].class_size == sum(g.class_id == got[d].class_id for g in got.values())


def test_classes_of_the_test_documents(spark):
    check(spark, spark.read.parquet(f"{SF_SMALL}/documents.parquet"))


def test_large_group_of_near_copies_with_outliers(spark):
    """Copies of one text with 0 to 16 edited words, so that many pairs are near the threshold."""
    rnd = random.Random(3)
    base, docs = prose(1, 120).split(), []
    for i in range(260):
        words = base[:]
        for _ in range(rnd.choice([0, 1, 1, 2, 3, 4, 8, 16])):
            words[rnd.randrange(len(words))] = f"edit{rnd.randrange(10 ** 6)}"
        docs.append((i, " ".join(words)))
    docs += [(1000 + i, prose(10 + i, 80) + " " + prose(2, 12)) for i in range(60)]  # a common passage doesn't join them
    check(spark, spark.createDataFrame(docs, "doc_id long, text string"))


def test_small_tiles_give_the_same_classes(spark, monkeypatch):
    monkeypatch.setattr(nd, "TILE_OUTSIDE", 3)
    monkeypatch.setattr(nd, "TILE_INSIDE", 5)
    monkeypatch.setattr(nd, "PROBE_TURNS", 0)
    monkeypatch.setattr(nd, "PAIRS_PER_BLOCK", 4)
    rnd = random.Random(8)
    base, docs = prose(1, 90).split(), []
    for i in range(70):
        words = base[:]
        for _ in range(rnd.choice([1, 2, 3, 4, 6])):
            words[rnd.randrange(len(words))] = f"edit{rnd.randrange(10 ** 6)}"
        docs.append((i, " ".join(words)))
    check(spark, spark.createDataFrame(docs, "doc_id long, text string"))


def test_samples_agree_as_often_as_the_weighted_jaccard_says():
    rng = np.random.default_rng(2)
    ids = np.sort(rng.choice(1 << 48, 400, replace=False).astype(np.uint64))
    wa, wb = rng.uniform(0.5, 4, 400), rng.uniform(0.5, 4, 400)
    a, b = np.flatnonzero(rng.random(400) < 0.8), np.flatnonzero(rng.random(400) < 0.8)
    fa, fb = np.zeros(400), np.zeros(400)
    fa[a], fb[b] = wa[a], np.where(rng.random(400) < 0.7, wa, wb)[b]
    true = np.minimum(fa, fb).sum() / np.maximum(fa, fb).sum()
    ha = nd.band_hashes(np.array([0, len(a)]), ids[a], fa[a], 1500, 1)
    hb = nd.band_hashes(np.array([0, len(b)]), ids[b], fb[b], 1500, 1)
    assert abs((ha == hb).mean() - true) < 0.05


def test_odd_rows(odd_docs, no_docs):
    got = nd.near_duplicates(odd_docs).collect()
    assert len(got) == odd_docs.count()
    by = sorted(((r.doc_id, r.class_id, r.class_size, r.kept) for r in got), key=str)
    assert by == sorted([(1, 1, 3, True), (1, 1, 3, False), (2, 1, 3, False), (3, 3, 3, True), (4, 3, 3, False), (None, 3, 3, False), (None, None, 1, True),
                         (5, 5, 1, True), (6, 6, 1, True), (6, 6, 1, True), (7, 7, 1, True), (8, 8, 1, True), (9, 9, 1, True)], key=str)
    kept = nd.keep_one_per_class(odd_docs)
    assert kept.columns == odd_docs.columns and kept.count() == sum(r.kept for r in got)
    assert kept.exceptAll(odd_docs).isEmpty()
    assert nd.near_duplicates(no_docs).collect() == [] and nd.keep_one_per_class(no_docs).collect() == []


@pytest.mark.parametrize("edges", [[(i, i + 1) for i in range(60)], [(1, 9), (9, 5), (5, 3), (7, 8)], [(0, i) for i in range(1, 50)], [(4, 3), (3, 4), (4, 3)], [(i, i + 1) for i in range(0, 400, 2)] + [(i, i + 1) for i in range(1, 399, 2)]])
def test_connected_components(spark, edges):
    up = {n: n for e in edges for n in e}

    def top(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in edges:
        up[max(top(a), top(b))] = min(top(a), top(b))
    pairs = spark.createDataFrame(edges, "a long, b long")
    got = connected_components(pairs).collect()
    assert connected_components(pairs.limit(0)).collect() == []
    assert sorted(r.node for r in got) == sorted(up)
    label = {r.node: r.label for r in got}
    assert all((label[a] == label[b]) == (top(a) == top(b)) for a in up for b in up)
    assert all(top(n) == top(x) for n, x in label.items())
