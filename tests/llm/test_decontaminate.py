import re

import duckdb
from conftest import SF_SMALL
from inclusio.llm import decontaminate as dc

from .conftest import prose


def grams(text):
    w = [x for x in re.split(r"[^\w]+|_", (text or "").lower()) if x]
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)}


def brute(docs, items):
    out = []
    for d, text in docs:
        have = grams(text)
        for i, item in items:
            want = grams(item)
            if i is not None and want and len(have & want) / len(want) >= 0.8:
                out.append((d, i, len(have & want), len(want)))
    return out


def key(r):
    return tuple((x is None, x or 0) for x in r)


def test_query_against_brute_force_and_sql(spark):
    from inclusio.llm.catalog import op5_decontaminate
    docs, items = (spark.read.parquet(f"{SF_SMALL}/{t}.parquet") for t in ("documents", "benchmark"))
    got = sorted((r.doc_id, r.item_id, r.shared, r.item_size) for r in op5_decontaminate(spark, SF_SMALL).collect())
    assert got == sorted(brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()]))
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_SMALL}/{t}.parquet'")
    assert got == sorted(con.sql(f"SELECT doc_id, item_id, shared, item_size FROM ({dc.oracle()})").fetchall())


def test_short_items_inside_long_documents(spark):
    """Whole, edited and scattered items of every size in documents a thousand times as long."""
    items, docs = [], []
    for i, n in enumerate((5, 6, 9, 14, 20, 40, 80, 200)):
        item = prose(i + 1, n)
        items.append((i, item))
        words = item.split()
        edited = words[:]
        edited[n // 2] = "changed"
        noise = prose(500 + i, 8000)
        scattered = " filler ".join(" ".join(words[a:a + 30]) for a in range(0, n, 30))
        docs += [(100 * i + 1, noise + ". " + item.upper() + "! " + noise), (100 * i + 2, noise + " " + " ".join(edited) + " " + noise),
                 (100 * i + 3, noise + " " + scattered), (100 * i + 4, noise + " " + " ".join(words[: n // 2]) + " " + noise)]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = sorted((r.doc_id, r.item_id, r.shared, r.item_size) for r in dc.contaminated(d, b).collect())
    assert got == sorted(brute(docs, items)) and {(100 * i + 1, i) for i in range(8)} <= {g[:2] for g in got}


def test_a_signature_reaches_every_containing_document(spark):
    """Whichever fifth of an item's shingles is lacking, one of the signature's is there."""
    items = dc.item_shingles(spark.createDataFrame([(1, prose(3, 44)), (2, prose(4, 9))], "item_id long, text string"))
    signed = {}
    for r in dc.signatures(items).collect():
        signed.setdefault(r.item_id, set()).add(r.s)
    for r in items.collect():
        assert len(signed[r.item_id]) > len(r.item_shingles) - 0.8 * len(r.item_shingles) - 1e-6


def test_odd_rows(spark, odd_docs, no_docs):
    bench = [(1, prose(1, 12)), (1, prose(1, 12)), (2, None), (3, ""), (4, "one two three"), (None, prose(2, 10)), (5, prose(2, 10)), (6, "x " * 30)]
    b = spark.createDataFrame(bench, "item_id long, text string")
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    got = [(r.doc_id, r.item_id, r.shared, r.item_size) for r in dc.contaminated(odd_docs, b).collect()]
    assert sorted(got, key=key) == sorted(brute(rows, [x for i, x in enumerate(bench) if i != 1]), key=key)
    left = dc.drop_contaminated(odd_docs, b)
    leaks = {t for d, t in rows if brute([(d, t)], bench)}
    assert left.columns == odd_docs.columns and leaks == {prose(1, 60), prose(2, 40)}
    assert sorted(map(str, left.collect())) == sorted(str(r) for r in odd_docs.collect() if r.text not in leaks)
    assert dc.contaminated(no_docs, b).collect() == [] and dc.contaminated(odd_docs, b.limit(0)).collect() == []
