import hashlib
import random
import re

from conftest import SF_SMALL
from inclusio.llm import pii

# the patterns as the base is defined, without the forms that keep them linear
PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
         "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def passes(kind, m):
    d = re.sub("[^0-9]", "", m)
    return {"email": True, "ip": kind != "ip" or all(int(o) <= 255 for o in m.split(".")),
            "card": 13 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]


def brute(text):
    return [f"{k}:{m.start()}:{m.end()}" for k, p in PLAIN.items() for m in re.finditer(p, text) if passes(k, m.group())]


def check(rows, texts):
    for r, t in zip(rows, texts):
        want = brute(t or "")
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest(), t
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(w.startswith(k) for w in want) for k in PLAIN]
        spans = r.spans.split(",") if r.spans else []
        assert set(want) <= set(spans)
        order = [(list(PLAIN).index(k), int(a)) for k, a, _ in (s.split(":") for s in spans)]
        assert order == sorted(order)


def test_query_against_brute_force(spark):
    from inclusio.llm.catalog import op4_pii
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()}
    rows = op4_pii(spark, SF_SMALL).collect()
    assert len(rows) == len(texts)
    check(rows, [texts[r.doc_id] for r in rows])


def test_random_and_adverse_texts(spark):
    rnd = random.Random(4)
    parts = ["a", "b1", "@", ".", "-", "+", " ", "(", ")", "9", "x.y", "a@b.co", "1.2.3.4", "4111 1111 1111 1111", "+1 (555) 123-4567", "é", "😀", "_", "\n", "255", "256", "007"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randrange(0, 40))) for _ in range(800)]
    texts += ["1" * 60_000, "a" * 60_000 + "@", "1 " * 20_000, "1." * 2_000, "a@" + "b." * 5_000, "+" + "1 " * 10_000, "", "0000000000000000"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = sorted(pii.report(df).collect(), key=lambda r: r.doc_id)
    check(rows, texts)


def test_candidates_beyond_the_base_are_judged_by_labelers(spark):
    good = [f"write to user{i}@mail.example.com now, call +1 (555) 123-{4000 + i} or pay by card 4111 1111 1111 1111 ok" for i in range(60)]
    more = ["please call phone: 555-123-4567 today", "serial 300.1.2.3 of version 999.1.1.1", "mail anna [at] example [dot] com please"]
    rows = pii.report(spark.createDataFrame(list(enumerate(good + more)), "doc_id long, text string")).collect()
    by = {r.doc_id: r.spans for r in rows}
    assert by[60] == "phone:19:31"
    assert by[62] == "email:5:32"
    assert by[61] == ""


def test_expectation_maximisation_finds_the_reliable_labelers():
    rnd = random.Random(2)
    truth, votes = [], {}
    for _ in range(4000):
        y = rnd.random() < 0.4
        v = tuple((1 if (rnd.random() < right) == y else -1) if rnd.random() > 0.2 else 0 for right in (0.95, 0.9, 0.85, 0.6, 0.5))
        truth.append((y, v))
        votes[v] = votes.get(v, 0) + 1
    patterns = [(0, v, n) for v, n in votes.items()]
    chance, model = pii.reliabilities(patterns)
    of = {v: c for (_, v, _), c in zip(patterns, chance)}
    assert sum((of[v] > 0.5) == y for y, v in truth) / len(truth) > 0.93
    share, rel = model[0]
    assert abs(share - 0.4) < 0.05
    assert rel[0][1][0] > 5 * rel[0][1][1] and rel[4][1][0] < 2 * rel[4][1][1]


def test_odd_rows(odd_docs, no_docs):
    rows = pii.report(odd_docs).collect()
    assert len(rows) == odd_docs.count() and all(r.n_email == 0 for r in rows)
    assert pii.report(no_docs).collect() == []
