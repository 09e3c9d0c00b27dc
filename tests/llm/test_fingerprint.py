import hashlib

import numpy as np
from conftest import SF_SMALL
from inclusio.llm.fingerprint import digests, edited_fingerprints, likeness


def brute(rows):
    """(doc_id, n_chars, sha of the edited text) in descending order, ties by text."""
    rows = sorted(((d, t or "") for d, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0), r[1].encode()))
    out = []
    for i, (d, t) in enumerate(rows):
        after, half = rows[(i + 1) % len(rows)][1], len(t) // 2
        edited = t[:len(t) - half] + after[:half]
        a, b, c = digests([t.encode(), edited.encode(), after.encode()])
        out.append((d, len(t), hashlib.sha256(edited.encode()).hexdigest(), a.tobytes().hex(), b.tobytes().hex(),
                    float(likeness(a[None], b[None])[0]), float(likeness(a[None], c[None])[0])))
    return out


def key(r):
    return (r[0] is None, r[0] or 0, *r[1:])


def test_query_against_brute_force(spark):
    from inclusio.llm.catalog import op2_fingerprints
    src = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    got = [tuple(r) for r in op2_fingerprints(spark, SF_SMALL).collect()]
    want = brute([(r.doc_id, r.text) for r in src.collect()])
    assert sorted(got, key=key) == sorted(want, key=key)
    assert np.mean([g[5] > g[6] for g in got]) > 0.95  # half of the own text is more alike than another text


def test_odd_rows(odd_docs, no_docs):
    got = [tuple(r) for r in edited_fingerprints(odd_docs).collect()]
    assert sorted(got, key=key) == sorted(brute([(r.doc_id, r.text) for r in odd_docs.collect()]), key=key)
    assert edited_fingerprints(no_docs).collect() == []
    lone = edited_fingerprints(odd_docs.where("doc_id = 8")).collect()
    assert len(lone) == 1 and lone[0].near_next == 1.0


def test_likeness_is_bounded_and_one_for_equal_texts():
    rng = np.random.default_rng(1)
    texts = [b"", b"abc", b"abcd" * 50, rng.bytes(5000), rng.bytes(5000), b"the same text " * 40]
    d = digests(texts)
    for a in d:
        for b in d:
            s = likeness(a[None], b[None])[0]
            assert 0 <= s <= 1 and s == likeness(b[None], a[None])[0]
        assert likeness(a[None], a[None])[0] == 1
    assert likeness(d[3:4], d[4:5])[0] < 0.5


def test_a_small_edit_is_nearer_than_a_large_one():
    text = " ".join(f"word{i % 97}y{i}" for i in range(800))
    small, large = text.replace("word5y", "edit"), text[:len(text) // 4] + "z q " * 1500
    d = digests([text.encode(), small.encode(), large.encode()])
    assert likeness(d[:1], d[1:2])[0] > 0.9 > likeness(d[:1], d[2:3])[0]
