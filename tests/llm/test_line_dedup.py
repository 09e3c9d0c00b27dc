import duckdb
from conftest import SF_SMALL
from inclusio.llm import line_dedup

from .conftest import prose


def make(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def test_spread_lines_go_but_for_the_first(spark):
    body = lambda i: f"own line {i} of this document, long enough to be the most of it"
    rows = [(i, f"{body(i)}\n  Accept cookies \nend {i}", f"s{i % 6}") for i in range(12)]
    rows += [(100 + i, f"{body(100 + i)}\nonly two sites\nend {100 + i}", f"s{i % 2}") for i in range(8)]
    got = {r.doc_id: r for r in line_dedup.line_report(make(spark, rows)).collect()}
    assert got[0].text == rows[0][1] and got[0].n_removed == 0
    assert all(got[i].text == f"{body(i)}\nend {i}" and got[i].n_removed == 1 and got[i].n_lines == 3 for i in range(1, 12))
    assert all(got[100 + i].text == rows[12 + i][1] for i in range(8))


def test_a_line_that_repeats_in_its_first_document(spark):
    rows = [(i, f"word {i} a b c d e f g\nad\nmore {i} words h i j k\nad", f"s{i}") for i in range(6)]
    got = {r.doc_id: r.text for r in line_dedup.line_report(make(spark, rows)).collect()}
    assert got[0] == "word 0 a b c d e f g\nad\nmore 0 words h i j k"
    assert got[3] == "word 3 a b c d e f g\nmore 3 words h i j k"


def test_copies_of_whole_documents_stay(spark):
    text = "first line of a copied text\nsecond line of it\nthird line of it"
    rows = [(i, text if i % 2 else text + f"\nvia {i}", f"s{i}") for i in range(10)]
    got = line_dedup.line_report(make(spark, rows)).collect()
    assert all(r.is_copy and r.n_removed == 0 for r in got)
    assert sorted(r.text for r in got) == sorted(t for _, t, _ in rows)


def test_threshold_is_exact(spark):
    rows = []
    for n in (4, 5, 6):  # a line at n sites, in many rows of one hot site
        rows += [(n * 1000 + i, f"unique {n} {i} with several words here\nline at {n} sites", "hot" if i >= n else f"s{i}") for i in range(n - 1)]
        rows += [(n * 1000 + 500 + i, f"unique too {n} {i} with several words here\nline at {n} sites", "hot") for i in range(40)]
    got = line_dedup.line_report(make(spark, rows)).collect()
    by = {n: sum(r.n_removed for r in got if r.doc_id // 1000 == n) for n in (4, 5, 6)}
    assert by == {4: 0, 5: 43, 6: 44}


def test_query_against_sql(spark):
    from inclusio.llm.catalog import op3_line_dedup
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF_SMALL}/documents.parquet'")
    want = con.sql(f"SELECT doc_id, n_lines, n_removed, is_copy, text_sha256 FROM ({line_dedup.oracle()})").fetchall()
    assert sorted(tuple(r) for r in op3_line_dedup(spark, SF_SMALL).collect()) == sorted(want)


def test_odd_rows(odd_docs, no_docs):
    out = line_dedup.dedup_lines(odd_docs)
    assert out.columns == odd_docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in odd_docs.schema]
    assert sorted(map(str, out.collect())) == sorted(map(str, odd_docs.collect()))  # nothing is spread
    assert line_dedup.dedup_lines(no_docs).collect() == []
    assert line_dedup.dedup_lines(odd_docs.drop("source", "n_chars")).count() == odd_docs.count()


def test_changed_rows_count_their_characters_anew(spark):
    rows = [(i, f"own words of document {i} a b c d\nshared", f"s{i}", 99) for i in range(6)]
    out = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars int"))
    assert all(r.n_chars == (99 if r.doc_id == 0 else len(r.text)) for r in out.collect())


def test_only_shown_copies_are_left_as_they_are(spark):
    notes = "We use cookies on this site to give you the best of it\nAll rights reserved by the owner of this site"
    rows = [(i, f"{notes}\n{prose(i, 8)}", f"s{i}") for i in range(6)]  # mostly notes, but each with its own text
    text = "\n".join(prose(50 + k, 12) for k in range(5))
    rows += [(10 + i, text, f"s{i}") for i in range(6)]
    got = {r.doc_id: r for r in line_dedup.line_report(make(spark, rows)).collect()}
    assert got[0].text == rows[0][1]
    assert all(got[i].text == prose(i, 8) and got[i].n_removed == 2 and not got[i].is_copy for i in range(1, 6))
    assert all(got[10 + i].text == text and got[10 + i].is_copy for i in range(6))


def test_passages_need_two_sites(spark):
    passage, limit = prose(70, 51), prose(71, 50)
    copied = "\n".join(prose(80 + k, 60) for k in range(4))
    rows = [(i, f"{prose(i, 70)}\n{passage}\n{limit}", f"s{i % 2}") for i in range(4)]  # two sites, no copies
    rows += [(10 + i, f"{prose(20 + i, 70)}\n{prose(72, 51)}", "hot") for i in range(4)]  # one site
    rows += [(20, copied, "s0"), (21, copied + "\nvia", "s1")]  # a copy is left to near-dedup
    rows += [(30, f"{prose(90, 70)}\n{prose(81, 60)}", "s2")]  # but a passage of it is not
    rows += [(40 + i, f"{passage}\n" + "\n".join(prose(100 + k, 60) for k in range(6)), f"s{i}") for i in range(2)]  # copies that took it
    got = {r.doc_id: r for r in line_dedup.line_report(make(spark, rows)).collect()}
    assert got[0].text == rows[0][1]
    assert all(got[i].text == f"{prose(i, 70)}\n{limit}" and got[i].n_removed == 1 for i in range(1, 4))
    assert all(got[d].text == t for d, t, _ in rows if 10 <= d < 30)
    assert got[30].text == prose(90, 70)
    assert got[40].text == got[41].text == "\n".join(prose(100 + k, 60) for k in range(6))
