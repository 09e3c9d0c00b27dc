import zlib

import numpy as np
import pyarrow as pa
import pytest
from conftest import SF_MID
from inclusio.llm import quality_fm as q
from inclusio.llm.vectext import buffers


@pytest.fixture(scope="module")
def mid(spark):
    docs, labels = (spark.read.parquet(f"{SF_MID}/{t}.parquet") for t in ("documents", "labels"))
    return docs, labels, q.train(docs, labels)


def test_held_out_accuracy(mid):
    docs, labels, machine = mid
    rows = q.quality_scores(docs, machine).collect()
    truth = {r.doc_id: r.quality for r in labels.collect()}
    assert len(rows) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    test = [(r.predicted, truth[r.doc_id]) for r in rows if r.held_out and r.doc_id in truth]
    assert np.mean([p == t for p, t in test]) > 0.93


def test_labels_of_held_out_rows_are_never_read(spark, mid):
    docs, labels, machine = mid
    wrong = labels.selectExpr("doc_id", "IF(crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 4 = 2, 1 - quality, quality) AS quality", "toxic")
    other = q.train(docs.selectExpr("doc_id", "text", "n_chars", "'x' AS lang", "'y' AS source"), wrong)
    assert np.array_equal(machine.v, other.v) and np.array_equal(machine.w, other.w)


def test_linear_time_score_is_the_sum_over_pairs():
    texts = ["a few words here, and a FEW more.", "", "one!! TWO!! one!!", "x " * 50]
    offs, data = buffers(pa.array(texts))
    stated = np.array([33.0, np.nan, 17, 100])
    rng = np.random.default_rng(1)
    size = q.WORD_CELLS + q.N_STATS * q.BINS
    m = q.Machine(np.sort(rng.uniform(0, 2, (q.N_STATS, q.BINS - 1)), axis=1), 0.1, rng.normal(0, 0.1, size), rng.normal(0, 0.2, (size, q.FACTORS)))
    stats, w = q.statistics(data, offs, stated)
    text, cell, value = q.word_cells(w)
    got = m.score(data, offs, stated)
    for i in range(len(texts)):
        x = np.zeros(size)
        x[cell[text == i]] = value[text == i]
        x[m.bins(stats)[i]] = 1
        on = np.flatnonzero(x)
        z = m.w0 + x @ m.w + sum(m.v[a] @ m.v[b] * x[a] * x[b] for k, a in enumerate(on) for b in on[:k])
        assert got[i] == pytest.approx(1 / (1 + np.exp(-z)), rel=1e-9)


def test_sample_is_bounded(mid):
    docs, labels, _ = mid
    small = q.train(docs, labels, sample=50)
    assert small is not None and not np.array_equal(small.w, mid[2].w)


def test_odd_rows(spark, odd_docs, no_docs, mid):
    _, labels, machine = mid
    rows = q.quality_scores(odd_docs, machine).collect()
    assert len(rows) == odd_docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert q.quality_scores(no_docs, machine).collect() == []
    assert {r.score for r in q.quality_scores(odd_docs, None).collect()} == {0.5}
    assert q.train(no_docs, labels) is None and q.train(odd_docs, labels.limit(0)) is None
    odd_labels = spark.createDataFrame([(1, None, 0), (None, 1, 0), (7, 1, 0), (7, 0, 0), (8, 1, None)], "doc_id long, quality int, toxic int")
    assert q.train(odd_docs, odd_labels) is not None
    kept = q.keep_good(odd_docs, machine)
    assert kept.columns == odd_docs.columns and kept.count() == sum(r.predicted for r in rows)
