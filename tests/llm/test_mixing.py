import math
import re

import duckdb
import pytest
from conftest import SF_SMALL
from inclusio.llm import mixing


def targets(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    """Deal again and again until no target is above its cap. sizes: by source, None last."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    out, free, rest = {}, set(names), share * sum(sizes.values())
    while free:
        level = rest / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > most * sizes[s]}
        if not over:
            out |= {s: level * weight[s] for s in free}
            break
        out |= {s: most * sizes[s] for s in over}
        rest -= sum(most * sizes[s] for s in over)
        free -= over
    return out


def check(rows, docs):
    sizes = {}
    for text, source in docs:
        sizes[source] = sizes.get(source, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    want = targets(sizes)
    taken = dict.fromkeys(sizes, 0)
    for r in rows:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source], rel=1e-9)
        assert 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 1
    # complete epochs before the fraction: within a source two documents differ by one epoch at most
    for r in rows:
        if r.source_size:
            epochs = math.floor(want[r.source] / sizes[r.source] + 1e-9)
            assert epochs * r.size <= r.taken <= min(2, epochs + 1) * r.size


def test_targets_and_epochs(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    got = mixing.mix(docs).collect()
    check(got, [(r.text, r.source) for r in docs.collect()])
    again = mixing.mix(docs.repartition(7)).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))


def test_query_against_sql(spark):
    from inclusio.llm.catalog import op1_source_mix
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF_SMALL}/documents.parquet'")
    want = con.sql(f"SELECT doc_id, size, source_size, round(target, 6), taken FROM ({mixing.oracle()})").fetchall()
    got = [(r.doc_id, r.size, r.source_size, round(r.target, 6), r.taken) for r in op1_source_mix(spark, SF_SMALL).collect()]
    assert sorted(got) == sorted(want)


def test_better_documents_go_first(spark):
    docs = spark.createDataFrame([(i, "word " * 10, s) for i in range(400) for s in ("a", "b")], "doc_id long, text string, source string")
    from pyspark.sql import functions as F
    got = mixing.mix(docs, quality=F.when(F.col("doc_id") < 200, 5.0).otherwise(0.2), weights=(1, 3), share=0.5).collect()
    good = sum(r.taken for r in got if r.doc_id < 200 and r.source == "a")
    assert good > 0.8 * sum(r.taken for r in got if r.source == "a") > 0


def test_odd_rows(odd_docs, no_docs):
    got = mixing.mix(odd_docs).collect()
    assert len(got) == odd_docs.count()
    check(got, [(r.text, r.source) for r in odd_docs.collect()])
    assert mixing.mix(no_docs).collect() == []
    only_empty = mixing.mix(odd_docs.where("text IS NULL")).collect()
    assert [r.taken for r in only_empty] == [0, 0]
