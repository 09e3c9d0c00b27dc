import math
import re

import duckdb
import pytest
from conftest import SF_SMALL
from inclusio.llm import catalog, lexical as L, terms

SMALL = str.maketrans(L._CAPITALS, L._SMALL)


def words(text):
    return [w.translate(SMALL) for w in re.findall(L.TERM, text or "")]


def brute_force(docs, items, k=50):
    """Scores of all pairs; ``docs`` and ``items`` as (id, text)."""
    found = [(i, words(t)) for i, t in docs]
    found = [(i, w) for i, w in found if w]
    big_n, big_l = len(found), sum(len(w) for _, w in found)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(words(t))
    out = []
    for item, need in asked.items():
        w = {t: math.floor(1000 * math.log((2 * big_n + 2) / (2 * sum(t in d for _, d in found) + 1))) for t in need}
        rows = []
        for doc, d in found:
            m = 50 + (50 * len(d) * big_n) // big_l
            score = sum(w[t] * ((10 ** 9 * d.count(t)) // (1000 * d.count(t) + 20 * m)) for t in need)
            if score > 0:
                rows.append((score, doc))
        rows.sort(key=lambda r: (-r[0], r[1] is None, r[1] or 0))
        out += [(item, n + 1, doc, score) for n, (score, doc) in enumerate(rows[:k])]
    return sorted(out, key=str)


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_query_equals_its_sql_and_brute_force(spark):
    got = found(catalog.op11_lexical_search(spark, SF_SMALL))
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_SMALL}/{t}.parquet'")
    assert got == sorted(con.execute(L.oracle()).fetchall(), key=str)
    docs, items = ([(r[0], r.text) for r in spark.read.parquet(f"{SF_SMALL}/{t}.parquet").collect()] for t in ("documents", "benchmark"))
    assert got == brute_force(docs, items)


@pytest.mark.parametrize("piece, visit, k", [(1, 1, 3), (3, 200, 2), (4096, 64 << 20, 50)])
def test_small_pieces_and_floors_change_nothing(spark, monkeypatch, piece, visit, k):
    monkeypatch.setattr(L, "PIECE", piece)
    monkeypatch.setattr(L, "VISIT_BYTES", visit)
    docs = [(i % 37, " ".join(f"w{(i * j) % 11}" for j in range(1, 2 + i % 9))) for i in range(120)]
    items = [(1, "w1 w2 W3"), (2, "w0"), (3, "w5 w7 none"), (4, "w9 w9 w10")]
    got = L.search(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), k)
    assert found(got) == brute_force(docs, items, k)


def test_items_in_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(L, "BLOCK_PAIRS", 3)
    docs = [(i, f"a{i % 5} b{i % 3} c") for i in range(40)]
    items = [(i, f"a{i % 5} b{i % 4}") for i in range(6)]
    got = L.search(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert found(got) == brute_force(docs, items)


def test_blocks_cut_texts_anywhere(monkeypatch):
    import pyarrow as pa
    texts = ["Hello, the World thé😀x the", "", None, "a", "foo" * 3 + " Zoo zoo9 " + "y" * 50, "ends", "x y", "\nThe"]
    v = L.Vocabulary([(1, w) for w in ("the", "zoo9", "thé😀x", "a", "x", "foofoofoo", "ends", "yyy")])
    names = sorted({"the", "zoo9", "thé😀x", "a", "x", "foofoofoo", "ends", "yyy"})
    for size in (1, 2, 3, 7, 64):
        monkeypatch.setattr(L, "blocks", lambda d, o, n, s=size: terms.blocks(d, o, n, s))
        n, text, term, tf = v.count(pa.array(texts))
        assert list(n) == [len(words(t)) for t in texts]
        want = {(i, w): words(t).count(w) for i, t in enumerate(texts) for w in words(t) if w in names}
        assert {(int(i), names[j]): int(c) for i, j, c in zip(text, term, tf)} == want


def test_equal_hashes_are_told_apart(monkeypatch):
    import numpy as np
    import pyarrow as pa
    v = L.Vocabulary([(1, "ab"), (1, "zz")])
    block = next(terms.blocks(np.frombuffer(b"ab cd", np.uint8), np.array([0, 5]), 2))
    monkeypatch.setattr(v.lookup, "find", lambda h: (np.array([0, 1]), np.array([0, 0])))
    assert [list(x) for x in v.find(block)] == [[0], [0]] and v.count(pa.array(["ab cd"]))[0][0] == 2


def test_odd_rows(spark, odd_docs, no_docs):
    items = spark.createDataFrame([(1, "alpha1x0 日本語 one"), (2, None), (None, "two"), (3, ""), (4, "nowhere"), (1, "Three")],
                                  "item_id long, text string").selectExpr("*", "'x' AS term", "1 AS rank", "2 AS doc_id")
    got = found(L.search(odd_docs, items))
    docs = [(r.doc_id, r.text) for r in odd_docs.collect()]
    assert got == brute_force(docs, [(r.item_id, r.text) for r in items.collect()])
    assert {r[0] for r in got} == {1, None}
    assert found(L.search(no_docs, items)) == found(L.search(odd_docs, items.limit(0))) == []
    assert L.search(no_docs, items).columns == ["item_id", "rank", "doc_id", "score"]
