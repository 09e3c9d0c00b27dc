import duckdb
import xxhash
from conftest import SF_SMALL
from inclusio.llm import url_filter as uf


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host, path = rest[:cut], rest[cut:]
    stop = min([path.find(c) for c in "?#" if c in path] or [len(path)])
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), path[:stop]


def brute(url, rules=uf.RULES, sites=uf.SPAM_SITES):
    host, path = parts(url)
    best = None
    for text, verdict in rules:
        h, p = text[:text.index("/")], text[text.index("/"):]
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(text) > len(best[0])):
            best = (text, verdict)
    if best:
        return host, path, *best
    spam = any(host == s or host.endswith("." + s) for s in sites)
    return host, path, None, "block" if spam else "allow"


URLS = ["http://a.example.com/en/1", "https://www.example.com/en/x?y#z", "https://WWW.Example.COM/en/", "http://deep.www.example.com/en/q", "http://notexample.com/en/",
        "http://com/", "http://x.net/es/", "http://x.net/es", "http://x.net/fr/?a=/es/", "http://x.org/es/", "http://spam-farm.example.org/a", "http://m.casino-win.example.net/de/1",
        "http://cheap-pills.example.com/", "http://cheap-pills.example.com", "http://a.com", "http://a.com?x=/y", "http://a.com#://b.net/es/", "a.com/en/", "", None, "://", "http://x.com//en/",
        "http://u:p@x.com:80/a", "x://y://z.com/", "http://ÄÖ.example.com/en/", "http://.com/", "http://a..net/es/b", "http://x.com/a\nb?c", "spam-farm.example.org"]


def test_urls_against_brute_force(spark):
    df = spark.createDataFrame([(i, u, "x") for i, u in enumerate(URLS)], "page_id long, url string, host string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in uf.judge_urls(df).collect()}
    assert got == {i: brute(u) for i, u in enumerate(URLS)}


def test_query_against_sql(spark):
    from inclusio.llm.catalog import op6_url_filter
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{SF_SMALL}/pages.parquet'")
    want = con.sql(f"SELECT page_id, host, path, rule, verdict FROM ({uf.oracle()})").fetchall()
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in op6_url_filter(spark, SF_SMALL).collect())


def table_of(entries, tmp_path):
    path = tmp_path / "list.bin"
    path.write_bytes(uf.pack(entries))
    return uf.DigestArray(str(path))


def test_equal_digests_are_told_apart_by_their_strings(tmp_path, monkeypatch):
    monkeypatch.setattr(xxhash, "xxh64_intdigest", lambda b: len(b) % 2)
    t = table_of([(f"site{i}.com", "block", False) for i in range(50)] + [("com/", "allow", True)], tmp_path)
    assert t.find([b"site7.com", b"site49.com", b"other.com", b"com/", b"net/"]).tolist() == [1, 1, -1, 2, -1]


def test_many_entries_and_an_empty_list(tmp_path):
    t = table_of([(f"h{i}.example", "block", False) for i in range(20_000)], tmp_path)
    assert (t.keys[1:] >= t.keys[:-1]).all()
    assert t.find([f"h{i}.example".encode() for i in range(0, 20_000, 7)]).tolist() == [1] * len(range(0, 20_000, 7))
    assert (t.find([f"g{i}.example".encode() for i in range(500)]) == -1).all()
    assert table_of([], tmp_path).find([b"x"]).tolist() == [-1]


def test_odd_rows(spark):
    df = spark.createDataFrame([(None, None), (1, "http://a.com/"), (1, "http://a.com/"), (None, "http://b.net/es/")], "page_id long, url string")
    got = sorted(map(str, ((r.page_id, r.rule, r.verdict) for r in uf.judge_urls(df).collect())))
    assert got == sorted(map(str, [(None, None, "allow"), (1, "com/", "allow"), (1, "com/", "allow"), (None, "net/es/", "block")]))
    assert uf.judge_urls(df.limit(0)).collect() == []


def test_a_blocklist_is_an_input(spark):
    listed = spark.createDataFrame([(e,) for e in ("adult-x.example.net", "https://Free-Bets.example.org/", "ads-track.example.org/px/", "# pharma.example", " ", None)], "entry string")
    urls = ["http://blog.adult-x.example.net/a", "http://free-bets.example.org", "http://a.ads-track.example.org/px/1", "http://ads-track.example.org/other", "http://pharma.example/",
            "http://spam-farm.example.org/", "http://adult-x.example.net/es/", "http://adult-x.example.net.org/"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = [r.verdict for r in sorted(uf.judge_urls(df, blocklist=listed).collect(), key=lambda r: r.page_id)]
    assert got == ["block", "block", "block", "allow", "allow", "block", "block", "allow"]
