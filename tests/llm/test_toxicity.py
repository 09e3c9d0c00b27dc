import functools
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from conftest import SF_MID
from inclusio.llm import catalog, terms, toxicity_mil as X


@pytest.fixture(scope="module")
def mid(spark):
    docs, labels = (spark.read.parquet(f"{SF_MID}/{t}.parquet") for t in ("documents", "labels"))
    return docs, labels, X.train(docs, labels)


@functools.lru_cache(None)
def signs_of(word):
    w = "".join(c.lower() if c.isascii() else c for c in word).encode()
    b = next(terms.blocks(np.frombuffer(w, np.uint8), np.array([0, len(w)]), X.LONGEST))
    return {int(b.hashes()[0])} | {int(b.prefix_hashes(k)[0]) for k in X.PREFIXES}


def independent(text, model):
    """Score and offending sentences of one text by regular expressions and single-term hashes."""
    weight = dict(zip(model.signs.tolist(), model.weights))
    good, found = 1.0, []
    for m in re.finditer(r"[^.!?\n]*(?:[.!?\n]|$)", text or ""):
        signs = set()
        for w in re.findall(r"[0-9A-Za-z\u0080-\U0010ffff]+", m[0]):
            signs |= signs_of(w)
        z = [weight[s] for s in signs if s in weight]
        if z:
            p = 1 / (1 + np.exp(-(model.bias + sum(z))))
            good *= 1 - p
            if p >= X.THRESHOLD:
                s = m[0]
                found.append((m.start() + len(s) - len(s.lstrip(" \t\r\n")), m.end(), pytest.approx(p)))
    return 1 - good, found


def test_scores_equal_an_independent_scorer(spark, mid):
    docs, _, model = mid
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = X.toxicity(docs, model).collect()
    assert len(rows) == len(texts)
    for r in rows:
        score, found = independent(texts[r.doc_id], model)
        assert r.score == pytest.approx(score, abs=1e-9)
        assert [(s.start, s.end, s.score) for s in r.sentences] == found
        assert all(texts[r.doc_id][s.start:s.end] == s.sentence for s in r.sentences)


def test_held_out_accuracy(spark, mid):
    _, labels, _ = mid
    rows = catalog.op13_toxicity(spark, SF_MID).collect()
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    test = [(r.predicted, truth[r.doc_id]) for r in rows if r.held_out and r.doc_id in truth]
    assert np.mean([p == t for p, t in test]) > 0.94
    assert np.mean([p for p, t in test if not t]) < 0.02


def test_labels_of_held_out_rows_are_never_read(spark, mid):
    docs, labels, model = mid
    wrong = labels.selectExpr("doc_id", "IF(crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 5 = 0, 1 - toxic, toxic) AS toxic", "0 AS quality")
    other = X.train(docs.selectExpr("doc_id", "text", "'x' AS lang", "'y' AS source"), wrong)
    assert np.array_equal(model.signs, other.signs) and np.array_equal(model.weights, other.weights) and model.bias == other.bias


def bags(n, seed, toxic_word="vile"):
    rng = np.random.default_rng(seed)
    names = [f"{a}{b}o" for a in "bcdfghklmnprstvw" for b in "aeiou"]
    texts, labels = [], []
    for i in range(n):
        lines = [" ".join(rng.choice(names, 8)) + "." for _ in range(rng.integers(1, 12))]
        if i % 4 == 0:
            at = rng.integers(len(lines))
            lines[at] = lines[at][:-1] + f" {toxic_word}{rng.integers(3)}."
        texts.append(" ".join(lines))
        labels.append(int(i % 4 == 0))
    return texts, np.array(labels)


def test_document_labels_locate_the_sentence():
    texts, labels = bags(600, 1)
    model = X.fit_model(pa.chunked_array([texts]), labels)
    new, truth = bags(200, 2)
    text, at, p = model.sentences(pa.array(new))
    assert (X.noisy_or(text, p, len(new)) >= 0.5).astype(int).tolist() == truth.tolist()
    for found, t, y in zip(X._locate(pa.array(new), text, at, p, 0.5), new, truth):
        assert [s["sentence"] for s in found] == [s for s in re.findall(r"[^. ][^.]*\.", t) if "vile" in s]


def test_copies_prove_nothing():
    """A word of a hundred copies of one toxic document is no sign."""
    texts, labels = bags(400, 3)
    copies = ["Quite zebra things here. A vile0 end."] * 100
    model = X.fit_model(pa.chunked_array([texts + copies]), np.append(labels, np.ones(100, int)))
    text, at, p = model.sentences(pa.array(["A zebra runs. Quite so."]))
    assert X.noisy_or(text, p, 1)[0] < 0.2


def test_blocks_cut_texts_anywhere(monkeypatch):
    texts, labels = bags(300, 4)
    model = X.fit_model(pa.chunked_array([texts]), labels)
    odd = pa.array([*texts[:8], "", None, "é😀. vile1!vile0", "vile0 " * 50])
    whole = model.sentences(odd)
    for size in (5, 17, 100):
        monkeypatch.setattr(X, "blocks", lambda d, o, n, s=size: terms.blocks(d, o, n, s))
        assert all(np.array_equal(a, b) for a, b in zip(model.sentences(odd), whole))


def test_long_text_takes_time_in_proportion(mid):
    import time
    _, _, model = mid
    took = []
    for n in (200_000, 400_000):
        texts = pa.array(["word another " * n])
        began = time.perf_counter()
        model.sentences(texts)
        took.append(time.perf_counter() - began)
    assert took[1] < 3 * took[0] + 0.5


def test_sample_is_bounded_whatever_the_rows(mid):
    docs, labels, _ = mid
    thrice = docs.unionByName(docs).unionByName(docs)
    assert X.sample_rows(thrice, labels, 40).count() == 40 and X.sample_rows(docs, labels, 40).count() == 40
    assert X.sample_rows(docs, labels).where("octet_length(text) > 32768").count() == 0


def test_odd_rows(spark, odd_docs, no_docs, mid):
    _, labels, model = mid
    rows = X.toxicity(odd_docs, model).collect()
    assert len(rows) == odd_docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert {r.score for r in rows if r.doc_id in (3, 4, 5, 9)} == {0.0}
    assert X.toxicity(no_docs, model).collect() == [] and X.offending_sentences(no_docs, model).collect() == []
    assert {r.score for r in X.toxicity(odd_docs, None).collect()} == {0.0}
    assert X.train(no_docs, labels) is None and X.train(odd_docs, labels.limit(0)) is None
    odd_labels = spark.createDataFrame([(1, None, 0), (None, 1, 0), (7, 1, 0), (7, 0, 1), (8, 1, None)], "doc_id long, quality int, toxic int")
    assert X.train(odd_docs, odd_labels) is None
    assert X.fit_model(pa.chunked_array([["", None]], pa.string()), np.array([1, 0])) is None
