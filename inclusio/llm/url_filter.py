"""URL filters: a sorted array of 64-bit digests, memory-mapped and probed by binary search.

The list (rules and blocked sites, strings ``host + path``) becomes one file: xxhash64 keys in
ascending order, verdicts, and the strings themselves.  Spark sends the file to every executor,
where all tasks map the same pages of it.  A url is probed by each of its parent domains joined
with each start of its path that is as long as some rule's path; equal digests count only when the
stored string is the probed one.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import shared_dir, ship

# The rules of the query (host + path, verdict)
RULES = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block")]
#: Sites that are blocked where no rule fits, whatever the path.
SPAM_NAMES = ["casino-win", "cheap-pills", "spam-farm"]
SPAM_SITES = [f"{name}.example.{top}" for name in SPAM_NAMES for top in ("com", "net", "org")]
#: Bound of the list: it is written by the driver and mapped by every executor.
MOST_ENTRIES = 50_000_000
_MAGIC = b"URLS0001"
VERDICTS = ("allow", "block")


def pack(entries: Iterable[tuple[str, str, bool]]) -> bytes:
    """The file of (host + path, verdict, is_rule): header, keys, marks, string ends, strings.  Of
    entries with one string a rule goes before a site, then block before allow."""
    best: dict[str, tuple[bool, int]] = {}
    for text, verdict, is_rule in entries:
        mark = (is_rule, VERDICTS.index(verdict))
        best[text] = max(best.get(text, mark), mark)
        if len(best) > MOST_ENTRIES:
            raise ValueError(f"more than {MOST_ENTRIES} entries")
    raw = [t.encode() for t in best]
    keys = np.array([xxhash.xxh64_intdigest(r) for r in raw], np.uint64)
    order = np.argsort(keys, kind="stable")
    marks = np.array([2 * rule + verdict for rule, verdict in best.values()], np.uint8)
    raw = [raw[i] for i in order]
    ends = np.cumsum([len(r) for r in raw]).astype(np.int64)
    lengths = np.array(sorted({len(t) - t.index("/") if "/" in t else 0 for t in best}), np.int64)
    head = np.array([len(raw), len(lengths)], np.int64)
    return b"".join([_MAGIC, head.tobytes(), lengths.tobytes(), keys[order].tobytes(), ends.tobytes(), marks[order].tobytes(), *raw])


class DigestArray:
    """A packed list, mapped from its file."""

    def __init__(self, path: str):
        data = np.memmap(path, np.uint8, "r")
        if data[:8].tobytes() != _MAGIC:
            raise ValueError("not a packed list")
        n, m = data[8:24].view(np.int64)
        self.path_lengths = data[24:24 + 8 * m].view(np.int64).tolist()
        at = 24 + 8 * m
        self.keys = data[at:at + 8 * n].view(np.uint64)
        self.ends = data[at + 8 * n:at + 16 * n].view(np.int64)
        self.marks = data[at + 16 * n:at + 17 * n]
        self.body = data[at + 17 * n:]

    def find(self, probes: list[bytes]) -> np.ndarray:
        """Marks of the probes (2 * is_rule + verdict), -1 where a probe isn't in the list."""
        out = np.full(len(probes), -1, np.int64)
        if not probes or not len(self.keys):
            return out
        want = np.array([xxhash.xxh64_intdigest(p) for p in probes], np.uint64)
        at = np.searchsorted(self.keys, want)
        todo = np.flatnonzero(at < len(self.keys))
        todo = todo[self.keys[at[todo]] == want[todo]]
        while len(todo):  # entries of one digest stand next to each other
            for i in todo:
                k = at[i]
                if self.body[self.ends[k - 1] if k else 0:self.ends[k]].tobytes() == probes[i]:
                    out[i] = self.marks[k]
            at[todo] += 1
            todo = todo[(out[todo] < 0) & (at[todo] < len(self.keys))]
            todo = todo[self.keys[at[todo]] == want[todo]]
        return out


def distribute(spark: SparkSession, entries: Iterable[tuple[str, str, bool]]) -> str:
    """Write the packed list to the shared folder and have Spark send it to all executors; returns
    its name there.  Equal lists are sent once."""
    data = pack(entries)
    name = f"urls-{hashlib.sha256(data).hexdigest()[:24]}.bin"
    jvm, sc = spark.sparkContext._jvm, spark.sparkContext
    if not any(f.endswith("/" + name) for f in sc.listFiles):
        path = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/inclusio-llm/{name}")
        fs = path.getFileSystem(sc._jsc.hadoopConfiguration())
        if not fs.exists(path):
            out = fs.create(path, True)
            for a in range(0, len(data), 1 << 20):
                out.write(bytearray(data[a:a + (1 << 20)]))
            out.close()
        sc.addFile(fs.makeQualified(path).toString())
    return name


def url_host(url: str = "url") -> Column:
    """From the first ``://`` to the next ``/``, ``?``, ``#`` or the end; A to Z in lower case."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.translate(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), upper, lower)


def url_path(url: str = "url") -> Column:
    """From the end of the host to the next ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


_LABEL = re.compile(r"\.")


def judge(hosts: list[str], paths: list[str], table: DigestArray) -> tuple[list[str | None], list[str]]:
    """(rule, verdict) of each url: the longest rule that fits, else the blocked sites, else allow."""
    probes, owner = [], []
    for i, (host, path) in enumerate(zip(hosts, paths)):
        parents = [host] + [host[m.end():] for m in _LABEL.finditer(host)] if host else []
        for domain in parents:
            for n in table.path_lengths:
                if n <= len(path):
                    probes.append(domain + path[:n])
                    owner.append(i)
    marks = table.find([p.encode() for p in probes])
    rules: list[str | None] = [None] * len(hosts)
    verdicts = ["allow"] * len(hosts)
    by_rule = [0] * len(hosts)
    for k in np.flatnonzero(marks >= 0):
        i, probe, mark = owner[k], probes[k], int(marks[k])
        if mark >= 2:
            if len(probe) > by_rule[i]:
                by_rule[i], rules[i], verdicts[i] = len(probe), probe, VERDICTS[mark - 2]
        elif not by_rule[i] and mark == 1:
            verdicts[i] = "block"
    return rules, verdicts


def list_entries(blocklist: DataFrame) -> list[str]:
    """Hosts and url prefixes of a table's column ``entry``, as host + path: without scheme, host in lower case,
    a bare ``/`` as the host alone.  Nulls, blank entries and lines that begin with ``#`` are left out."""
    entry = F.regexp_replace(F.trim("entry"), r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host, path = F.lower(F.regexp_extract(entry, r"^([^/]*)", 1)), F.regexp_extract(entry, r"^[^/]*(/.+)$", 1)
    rows = (blocklist.where("entry IS NOT NULL AND trim(entry) NOT LIKE '#%'").select(F.concat(host, path).alias("entry"), host.alias("host"))
            .where("host != ''").select("entry").distinct().limit(MOST_ENTRIES + 1))  # the driver packs the list
    return [r.entry for r in rows.toLocalIterator()]


def judge_urls(pages: DataFrame, rules=RULES, blocked_sites=SPAM_SITES, blocklist: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict of every row of ``pages`` (page_id, url, ...).

    ``rules``: (host + path, verdict); a rule fits its host and all subdomains if the path starts
    with the rule's, and the longest decides.  Where none fits, a site of ``blocked_sites`` (with its
    subdomains) or an entry of the table ``blocklist`` (column entry: hosts and url prefixes, see
    ``list_entries``) is blocked and all else allowed.  A null url, or one without ``://``, has an empty
    host and path, fits no rule and is allowed.  A null page_id stays null; repeated rows give a row
    each; columns other than page_id and url are not read; an empty table gives an empty result."""
    spark = pages.sparkSession
    ship(spark)
    listed = [*blocked_sites, *(list_entries(blocklist) if blocklist is not None else [])]
    name = distribute(spark, [(t, v, True) for t, v in rules] + [(s, "block", False) for s in listed])

    def run(batches):
        table = DigestArray(SparkFiles.get(name))
        for batch in batches:
            rules, verdicts = judge(batch.column("host").to_pylist(), batch.column("path").to_pylist(), table)
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("host"), batch.column("path"), pa.array(rules, pa.string()), pa.array(verdicts, pa.string())],
                                             ["page_id", "host", "path", "rule", "verdict"])

    return (pages.select(F.col("page_id").cast("long").alias("page_id"), url_host().alias("host"), url_path().alias("path"))
            .mapInArrow(run, "page_id long, host string, path string, rule string, verdict string"))


def oracle() -> str:
    """DuckDB SQL of the query: rules as a table, the longest that fits by a window."""
    rules = ", ".join(f"('{t[:t.index('/')]}', '{t[t.index('/'):]}', '{v}')" for t, v in RULES)
    sites = ", ".join(f"('{s}')" for s in SPAM_SITES)
    return f"""
WITH u AS (
  SELECT page_id, coalesce(url, '') AS url, row_number() OVER () AS row_no FROM pages
), p AS (
  SELECT row_no, page_id,
         translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
  FROM u
), rules(rule_host, rule_path, verdict) AS (VALUES {rules}),
sites(site) AS (VALUES {sites}),
fits AS (
  SELECT row_no, rule_host || rule_path AS rule, verdict,
         row_number() OVER (PARTITION BY row_no ORDER BY length(rule_host || rule_path) DESC) AS nth
  FROM p JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
), spam AS (
  SELECT DISTINCT row_no FROM p JOIN sites ON host = site OR ends_with(host, '.' || site)
)
SELECT p.page_id, p.host, p.path, f.rule,
       CASE WHEN f.verdict IS NOT NULL THEN f.verdict WHEN s.row_no IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict
FROM p LEFT JOIN (SELECT * FROM fits WHERE nth = 1) f USING (row_no) LEFT JOIN spam s USING (row_no)
"""
