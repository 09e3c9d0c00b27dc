"""Ranked lexical search over a length-stratified index.

A term's part in a document's score depends on its weight, its occurrences tf and the document's length
normaliser m alone.  The index therefore groups the documents of equal m in strata (cut into *pieces* of
at most ``PIECE`` documents, so that no stratum is too large for a task) and, within a piece, a term's
postings by tf: an impact is computed once per tf, not once per posting.  A piece also states each
term's largest tf, which bounds the score that any of its documents can have for an item.

Steps of ``search``:

1. one pass over the texts counts each document's terms and the occurrences of the terms that an item
   asks for (others can't add to a score; they count in n, N and L);
2. N, L and document frequencies are aggregated, giving m and the weights;
3. documents are range-partitioned by m (and a hash, so that a frequent m spreads over tasks) and
   written as pieces;
4. each item's piece of highest bound, over the whole index, is scored first: its k-th best score is a
   floor that any result must reach;
5. every task visits its pieces in order of falling bound, for each item, until the bound falls below
   the floor or the k-th best score so far, and gives at most k documents an item.

All scores are exact integers; no document is left out but by a bound.
"""

from __future__ import annotations

import math
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import ship, staged, text_or_empty
from .terms import LOW, Lookup, blocks, hash_terms
from .vectext import buffers

TOP = 50
#: Documents in a piece of a stratum.
PIECE = 4096
#: Pairs of an item and a term that one pass over the documents serves (a larger set takes more passes).
BLOCK_PAIRS = 1 << 18
#: Postings of the pieces that a task visits together, in bytes.
VISIT_BYTES = 64 << 20
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_CAPITALS, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def item_terms(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, term) pairs, once each."""
    found = F.regexp_extract_all(F.translate(text_or_empty(text_col), _CAPITALS, _SMALL), F.lit(TERM), F.lit(0))
    return items.select(F.col(id_col).cast("long").alias("item_id"), F.explode(found).alias("term")).distinct()


class Vocabulary:
    """The terms that a block of items asks for, numbered, and each item's terms."""

    def __init__(self, pairs: list[tuple]):
        terms = sorted({t for _, t in pairs})
        number = {t: i for i, t in enumerate(terms)}
        packed = [t.encode() for t in terms]
        self.longest = max(map(len, packed), default=1)
        self.lookup = Lookup(hash_terms(packed))
        self.bytes = np.frombuffer(b"".join(packed), np.uint8)
        self.first = np.concatenate(([0], np.cumsum([len(p) for p in packed]))).astype(np.int64)
        self.ids = sorted({i for i, _ in pairs}, key=lambda i: (i is None, i))
        place = {i: n for n, i in enumerate(self.ids)}
        rows = sorted((place[i], number[t]) for i, t in pairs)
        self.item = np.array([i for i, _ in rows], np.int64)
        self.term = np.array([t for _, t in rows], np.int64)
        self.n_terms = len(terms)

    def find(self, block) -> tuple[np.ndarray, np.ndarray]:
        """(positions, term numbers) of a block's terms that are in the vocabulary, compared byte by byte."""
        at, term = self.lookup.find(block.hashes())
        same = block.size[at] == self.first[term + 1] - self.first[term]
        at, term = at[same], term[same]
        size = block.size[at]
        each = np.repeat(np.arange(len(at)), size)
        step = np.arange(len(each)) - np.repeat(np.cumsum(size) - size, size)
        wrong = block.low[block.start[at][each] + step] != self.bytes[self.first[term][each] + step]
        if wrong.any():
            keep = np.bincount(each[wrong], minlength=len(at)) == 0
            at, term = at[keep], term[keep]
        return at, term

    def count(self, texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of a string column: terms per text, and (text, term, occurrences) sorted by text and term."""
        offs, data = buffers(texts)
        n = np.zeros(len(texts), np.int64)
        keys, times = [], []
        for b in blocks(data, offs, self.longest):
            n += np.bincount(b.text, minlength=len(texts))
            at, term = self.find(b)
            k, c = np.unique(b.text[at] * self.n_terms + term, return_counts=True)
            keys.append(k)
            times.append(c)
        key = np.concatenate(keys) if keys else np.zeros(0, np.int64)
        tf = np.concatenate(times) if times else np.zeros(0, np.int64)
        distinct, where = np.unique(key, return_inverse=True)  # a text may stand in several blocks
        total = np.zeros(len(distinct), np.int64)
        np.add.at(total, where, tf)
        return n, distinct // max(self.n_terms, 1), distinct % max(self.n_terms, 1), total


def _pack(arrays) -> pa.Array:
    return pa.array([a.tobytes() for a in arrays], pa.binary())


def _ints(cell: bytes, kind=np.int32) -> np.ndarray:
    return np.frombuffer(cell, kind)


def count_terms(docs: DataFrame, vocabulary) -> DataFrame:
    """(doc_id, n, terms, tfs) of every row with a term: its terms of the vocabulary and their occurrences."""
    def run(batches):
        v = vocabulary.value
        for batch in batches:
            n, text, term, tf = v.count(batch.column("text"))
            first = np.searchsorted(text, np.arange(len(n) + 1))
            some = np.flatnonzero(n)
            term, tf = term.astype(np.int32), tf.astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(some)), pa.array(n[some]),
                 _pack(term[first[i]:first[i + 1]] for i in some), _pack(tf[first[i]:first[i + 1]] for i in some)],
                ["doc_id", "n", "terms", "tfs"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(
        run, "doc_id long, n long, terms binary, tfs binary")


def document_frequencies(hits: DataFrame, n_terms: int) -> DataFrame:
    """(term, df) of the vocabulary's terms that a document holds."""
    def run(batches):
        df = np.zeros(n_terms, np.int64)
        for batch in batches:
            df += np.bincount(np.frombuffer(b"".join(batch.column("terms").to_pylist()), np.int32), minlength=n_terms)
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(df[some])], ["term", "df"])

    return hits.select("terms").mapInArrow(run, "term int, df long").groupBy("term").agg(F.sum("df").alias("df"))


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def impacts(tf: np.ndarray, m) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 20 * m)


PIECE_COLUMNS = "piece long, m long, size long, top_terms binary, top_tfs binary, docs binary, nulls binary, terms binary, tfs binary, firsts binary, places binary"


def stratify(hits: DataFrame, n_docs: int, n_all: int) -> DataFrame:
    """The index: documents of equal m in pieces; in a piece the groups of equal (term, tf), ascending,
    with the places of their documents, and each term's largest tf."""
    m = F.expr(f"50 + (50 * n * {n_docs}L) div {n_all}L")
    rows = hits.where("octet_length(terms) > 0").select(m.alias("m"), "doc_id", "terms", "tfs")
    ranged = rows.repartitionByRange("m", F.xxhash64("doc_id", "terms")).sortWithinPartitions("m")

    def piece(m, docs, cells, tf_cells):
        sizes = [len(c) // 4 for c in cells]
        place = np.repeat(np.arange(len(cells), dtype=np.int32), sizes)
        term = np.frombuffer(b"".join(cells), np.int32)
        tf = np.frombuffer(b"".join(tf_cells), np.int64)
        order = np.lexsort((place, tf, term))
        term, tf, place = term[order], tf[order], place[order]
        first = np.flatnonzero(np.concatenate(([True], (term[1:] != term[:-1]) | (tf[1:] != tf[:-1]))))
        g_term, g_tf = term[first], tf[first]
        last = np.flatnonzero(np.append(g_term[1:] != g_term[:-1], True))
        ids = docs.fill_null(0).to_numpy(zero_copy_only=False)
        nulls = docs.is_null().to_numpy(zero_copy_only=False)
        return (int(m), len(cells), *[x.tobytes() for x in (g_term[last], g_tf[last], ids, nulls, g_term, g_tf, np.append(first, len(term)).astype(np.int32), place)])

    names = [c.split()[0] for c in PIECE_COLUMNS.split(", ")]
    kinds = [pa.int64()] * 3 + [pa.binary()] * 8

    def run(batches):
        number = count(TaskContext.get().partitionId() << 32)
        for batch in batches:
            ms = batch.column("m").to_numpy()
            cut = np.flatnonzero(np.concatenate(([True], ms[1:] != ms[:-1])))
            for a, z in zip(cut, np.append(cut[1:], len(ms))):
                for s in range(a, z, PIECE):
                    part = batch.slice(s, min(PIECE, z - s))
                    row = (next(number), *piece(ms[s], part.column("doc_id"), part.column("terms").to_pylist(), part.column("tfs").to_pylist()))
                    yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds)], names)

    return ranged.mapInArrow(run, PIECE_COLUMNS)


class Query:
    """Items with weighted terms, as a task needs them."""

    def __init__(self, v: Vocabulary, weights: np.ndarray, floors: np.ndarray | None = None, k: int = TOP):
        keep = weights[v.term] > 0
        self.item, self.term, self.k = v.item[keep], v.term[keep], k
        self.weights, self.n_items, self.n_terms = weights, len(v.ids), v.n_terms
        self.first = np.searchsorted(self.item, np.arange(self.n_items + 1))
        self.floors = np.ones(self.n_items, np.int64) if floors is None else floors

    def bounds(self, m: int, terms: np.ndarray, tfs: np.ndarray) -> np.ndarray:
        """Highest score that a document of a piece can have, for each item."""
        best = np.zeros(self.n_terms, np.int64)
        best[terms] = impacts(tfs, m)
        out = np.zeros(self.n_items, np.int64)
        np.add.at(out, self.item, (self.weights * best)[self.term])
        return out


class Piece:
    """One piece in memory; its impacts are computed once per (term, tf)."""

    def __init__(self, row):
        self.m, self.size = row["m"], row["size"]
        self.docs, self.nulls = _ints(row["docs"], np.int64), _ints(row["nulls"], bool)
        self.terms, self.firsts, self.places = _ints(row["terms"]), _ints(row["firsts"]), _ints(row["places"])
        self.impacts = impacts(_ints(row["tfs"], np.int64), self.m)

    def scores(self, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """The score of each document for the given terms."""
        out = np.zeros(self.size, np.int64)
        lo, hi = np.searchsorted(self.terms, terms), np.searchsorted(self.terms, terms, side="right")
        n = hi - lo
        group = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
        a, n_posts = self.firsts[group].astype(np.int64), np.diff(self.firsts)[group].astype(np.int64)
        post = np.repeat(a - (np.cumsum(n_posts) - n_posts), n_posts) + np.arange(n_posts.sum())
        np.add.at(out, self.places[post], np.repeat(np.repeat(weights, n) * self.impacts[group], n_posts))
        return out


class Best:
    """The k best (score, doc_id) of one item so far: highest score, then least doc_id, null last."""

    def __init__(self, k: int, floor: int):
        self.k, self.floor = k, floor
        self.score, self.doc, self.null = (np.zeros(0, x) for x in (np.int64, np.int64, bool))

    def add(self, score, doc, null):
        keep = score >= self.floor
        score, doc, null = (np.concatenate((x, y[keep])) for x, y in ((self.score, score), (self.doc, doc), (self.null, null)))
        order = np.lexsort((doc, null, -score))[:self.k]
        self.score, self.doc, self.null = score[order], doc[order], null[order]
        if len(order) == self.k:
            self.floor = max(self.floor, int(self.score[-1]))


def _found(best: list[Best]) -> pa.RecordBatch:
    item = np.repeat(np.arange(len(best), dtype=np.int32), [len(b.score) for b in best])
    score, doc, null = (np.concatenate([getattr(b, c) for b in best]) for c in ("score", "doc", "null"))
    return pa.RecordBatch.from_arrays([pa.array(item), pa.array(doc, mask=null), pa.array(score)], ["item", "doc_id", "score"])


def best_pieces(index: DataFrame, query) -> DataFrame:
    """(item, piece): the piece of the whole index with the item's highest bound.  Reads the bounds' columns only."""
    def run(batches):
        q = query.value
        top, of = np.zeros(q.n_items, np.int64), np.zeros(q.n_items, np.int64)
        for batch in batches:
            for row in batch.to_pylist():
                b = q.bounds(row["m"], _ints(row["top_terms"]), _ints(row["top_tfs"], np.int64))
                better = b > top
                top[better], of[better] = b[better], row["piece"]
        some = np.flatnonzero(top)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(of[some]), pa.array(top[some])], ["item", "piece", "bound"])

    return (index.select("piece", "m", "top_terms", "top_tfs").mapInArrow(run, "item int, piece long, bound long")
            .groupBy("item").agg(F.max_by("piece", F.struct("bound", "piece")).alias("piece")))


def visit(index: DataFrame, query, only: dict | None = None) -> DataFrame:
    """(item, doc_id, score): each task's best documents, pieces visited by falling bound.  ``only``: the
    items that ask for a piece (all by default)."""
    def run(batches):
        q = query.value
        best = [Best(q.k, int(f)) for f in q.floors]

        def go(rows):
            pieces: dict[int, Piece] = {}
            bounds = np.array([q.bounds(r["m"], _ints(r["top_terms"]), _ints(r["top_tfs"], np.int64)) for r in rows])
            for i, b in enumerate(best):
                terms = q.term[q.first[i]:q.first[i + 1]]
                for r in np.argsort(-bounds[:, i], kind="stable"):
                    if bounds[r, i] < b.floor or not bounds[r, i]:
                        break
                    if only is not None and i not in only[rows[r]["piece"]]:
                        continue
                    if r not in pieces:
                        pieces[r] = Piece(rows[r])
                    p = pieces[r]
                    b.add(p.scores(terms, q.weights[terms]), p.docs, p.nulls)

        held, size = [], 0
        for batch in batches:
            for row in batch.to_pylist():
                held.append(row)
                size += len(row["places"]) + len(row["terms"]) * 4
                if size > VISIT_BYTES:
                    go(held)
                    held, size = [], 0
        if held:
            go(held)
        if best:
            yield _found(best)

    return index.mapInArrow(run, "item int, doc_id long, score long")


def _search_block(docs: DataFrame, pairs: list[tuple], k: int) -> DataFrame | None:
    spark = docs.sparkSession
    v = Vocabulary(pairs)
    hits = staged(count_terms(docs, spark.sparkContext.broadcast(v)), "lexical-hits")
    n_docs, n_all = hits.agg(F.count(F.lit(1)), F.sum("n")).first()
    if not n_docs:
        return None
    df = np.zeros(v.n_terms, np.int64)
    for r in document_frequencies(hits, v.n_terms).collect():  # the block's vocabulary at most
        df[r.term] = r.df
    weights = np.array([weight(n_docs, int(x)) for x in df], np.int64)
    index = staged(stratify(hits, n_docs, n_all), "lexical-index")
    seen = {r.item: r.piece for r in best_pieces(index, spark.sparkContext.broadcast(Query(v, weights, k=k))).collect()}  # one an item
    only: dict[int, set] = {}
    for item, piece in seen.items():
        only.setdefault(piece, set()).add(item)
    first = spark.sparkContext.broadcast(Query(v, weights, k=k))
    floors = np.ones(len(v.ids), np.int64)
    if only:
        scored = visit(index.where(F.col("piece").isin(list(only))), first, only)
        kth = scored.withColumn("rank", _ranks("item")).where(F.col("rank") == k)
        for r in kth.select("item", "score").collect():  # one an item
            floors[r.item] = r.score
    found = visit(index, spark.sparkContext.broadcast(Query(v, weights, floors, k)))
    ids = spark.createDataFrame([(n, i) for n, i in enumerate(v.ids)], "item int, item_id long")  # one block's items
    return found.withColumn("rank", _ranks("item")).where(F.col("rank") <= k).join(F.broadcast(ids), "item").select("item_id", "rank", "doc_id", "score")


def _ranks(by: str):
    return F.row_number().over(Window.partitionBy(by).orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))


RESULT = "item_id long, rank int, doc_id long, score long"


def search(docs: DataFrame, items: DataFrame, k: int = TOP) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` documents of ``docs`` (doc_id, text, ...) with the highest
    score above 0 for each item of ``items`` (item_id, text, ...).

    Whole texts of any length are read.  A null or empty text has no terms; a row of ``docs`` without terms
    isn't a document of the counts and is never found.  Each row of ``docs`` is a document, repeated ones
    too; equal scores go by ascending doc_id, null last.  Rows of ``items`` with one item_id (null ones
    likewise) are one item with the terms of all of them; an item without terms, or whose terms no document
    holds, has no rows.  Without documents or items the result is empty; other columns are not read."""
    spark: SparkSession = docs.sparkSession
    ship(spark)
    pairs = staged(item_terms(items), "lexical-items")
    n_blocks = -(-pairs.count() // BLOCK_PAIRS)
    out = None
    for b in range(n_blocks):
        here = pairs.where(F.pmod(F.xxhash64("item_id"), F.lit(n_blocks)) == b) if n_blocks > 1 else pairs
        rows = [tuple(r) for r in here.collect()]  # about BLOCK_PAIRS of them
        got = _search_block(docs, rows, k) if rows else None
        out = got if out is None else out if got is None else out.unionByName(got)
    return spark.createDataFrame([], RESULT) if out is None else out


def oracle() -> str:
    """DuckDB SQL of the search over ``documents`` and ``benchmark``, all pairs by their terms."""
    def terms(table, key):
        return (f"SELECT {key}, unnest(regexp_extract_all(translate(coalesce(text, ''), '{_CAPITALS}', '{_SMALL}'), '{TERM}')) AS term FROM {table}")
    return f"""
WITH d AS (SELECT doc_id, text, row_number() OVER () AS rid FROM documents),
t AS ({terms("d", "rid, doc_id")}),
n AS (SELECT rid, any_value(doc_id) AS doc_id, count(*) AS n FROM t GROUP BY rid),
z AS (SELECT count(*) AS nn, CAST(sum(n) AS BIGINT) AS l FROM n),
q AS (SELECT DISTINCT item_id, term FROM ({terms("benchmark", "item_id")}) i),
p AS (SELECT rid, term, count(*) AS tf FROM t WHERE term IN (SELECT term FROM q) GROUP BY rid, term),
w AS (SELECT term, CAST(floor(1000e0 * ln(CAST(2 * nn + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w
      FROM p, z GROUP BY term, nn),
i AS (SELECT p.rid, p.term, w.w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n.n * z.nn) // z.l))) AS part
      FROM p JOIN n USING (rid) JOIN w USING (term), z),
s AS (SELECT q.item_id, i.rid, CAST(sum(part) AS BIGINT) AS score FROM q JOIN i USING (term) GROUP BY q.item_id, i.rid),
r AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank, doc_id, score
      FROM s JOIN n USING (rid) WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM r WHERE rank <= {TOP}"""
