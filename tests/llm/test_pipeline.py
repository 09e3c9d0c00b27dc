"""Each stage against brute force on its own input, then the whole run."""

import hashlib

import corpus_pipeline as cp
import pytest
from conftest import SF_SMALL
from inclusio.llm import near_dup, quality_fm
from inclusio.llm.common import staged

from .test_decontaminate import brute as brute_leaks
from .test_mixing import check as check_mix
from .test_near_dup import brute_classes

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    out = [docs]
    for name, stage in cp.STAGES:
        out.append(staged(stage(spark, out[-1], SF_SMALL), "test-stage"))
    return out


def rows(df):
    return sorted(tuple(r) for r in df.select(*COLUMNS).collect())


def test_all_but_the_last_return_the_columns_of_documents(stages):
    assert len(cp.STAGES) == 5 and all(s.columns == COLUMNS for s in stages[:-1])


def test_quality_keeps_what_the_classifier_accepts(spark, stages):
    machine = quality_fm.train(stages[0], spark.read.parquet(f"{SF_SMALL}/labels.parquet"))
    good = {r.doc_id for r in quality_fm.quality_scores(stages[0], machine).where("predicted = 1").collect()}
    assert rows(stages[1]) == [r for r in rows(stages[0]) if r[0] in good] and 0 < len(good) < stages[0].count()


def test_line_dedup_by_brute_force(stages):
    before, after = rows(stages[1]), {r[0]: r for r in rows(stages[2])}
    lines = {}
    for d, text, _, source, _ in before:
        for pos, line in enumerate(text.split("\n")):
            if line.strip():
                sites, first = lines.get(line.strip(), (set(), (d, pos)))
                lines[line.strip()] = (sites | {source}, min(first, (d, pos)))
    wide = {k: first for k, (sites, first) in lines.items() if len(sites) >= 5}
    assert wide
    for d, text, lang, source, n in before:
        own = [(pos, x) for pos, x in enumerate(text.split("\n")) if x.strip() in wide]
        copy = sum(len(x.strip()) for _, x in own) / max(1, len(text)) >= 0.35
        gone = set() if copy else {pos for pos, x in own if wide[x.strip()] != (d, pos)}
        want = "\n".join(x for pos, x in enumerate(text.split("\n")) if pos not in gone)
        assert after[d] == (d, want, lang, source, len(want) if gone else n)


def test_one_document_of_each_class_stays(stages):
    before = rows(stages[2])
    top = brute_classes([r[1] for r in before], near_dup.cell_weights(stages[2]))
    assert rows(stages[3]) == [r for i, r in enumerate(before) if top[i] == i]


def test_no_document_contains_a_benchmark_item(spark, stages):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").collect()]
    before = rows(stages[3])
    leaks = {d for d, *_ in brute_leaks([(r[0], r[1]) for r in before], items)}
    assert rows(stages[4]) == [r for r in before if r[0] not in leaks]


def test_mix_meets_its_targets(stages):
    from inclusio.llm import mixing
    check_mix(mixing.mix(stages[4]).collect(), [(r[1], r[3]) for r in rows(stages[4])])
    assert stages[5].where("taken <= 0").isEmpty()


def test_run_gives_the_rows_of_the_last_stage(spark, stages):
    digest = lambda df: hashlib.sha256(str(sorted(map(str, df.collect()))).encode()).hexdigest()
    assert digest(cp.run(spark, SF_SMALL)) == digest(stages[5])


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").limit(0)
    for name, stage in cp.STAGES:
        docs = staged(stage(spark, docs, SF_SMALL), "test-stage")
        assert docs.collect() == []
