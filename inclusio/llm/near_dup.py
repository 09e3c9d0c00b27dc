"""Near-duplicate documents: improved consistent weighted sampling over TF-IDF shingles.

1. Rows with equal texts share a 128-bit digest; each digest is one *text* from here on.
2. Document frequencies are counted for every shingle of every row, in a table of 2**18 hashed
   cells (its size does not grow with the corpus).
3. Each text gets ``BANDS`` x ``ROWS`` consistent weighted samples of its shingles, weighted by
   term frequency times inverse document frequency.  Two texts agree on one sample with a
   probability equal to their weighted Jaccard similarity.  ``ROWS`` samples make a band.
4. Texts of one band bucket are compared with the bucket's representative; links that pass the
   exact (weighted) Jaccard similarity join classes (connected components).
5. In buckets that still hold several classes, texts outside the largest class are compared with
   a few of its members, then those still outside with every text of another class, so that no
   link between texts that share a band is lost.

Nothing that grows with the corpus reaches the driver: only the 2**18 cell counts do.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, functions as F

from .common import CHUNK_BYTES, ship, staged, text_key, text_or_empty
from .components import connected_components
from .vectext import ID_BITS, Words, buffers, mix, shingle_ids, steps

BANDS = 12
ROWS = 3
THRESHOLD = 0.8
CELL_BITS = 18
#: Pairs of one representative that meet in one task; more are dealt over several.
PAIRS_PER_BLOCK = 1000
#: Total weights of linked texts differ by the threshold at most; the slack is for the plain similarity.
RATIO_SLACK = 0.9
#: Turns in which texts outside a bucket's largest class are compared with one member of it, before
#: the rest is compared with all members: they settle most texts of large groups of copies.
PROBE_TURNS = 1
#: Texts of a tile's two sides in the last comparison.
TILE_OUTSIDE = 256
TILE_INSIDE = 1024
#: Stands for a null doc_id: it orders after all others.
NO_ID = (1 << 63) - 1
_U = np.uint64


def _cells(ids: np.ndarray) -> np.ndarray:
    return (ids >> _U(ID_BITS - CELL_BITS)).astype(np.int64)


def cell_weights(docs: DataFrame) -> np.ndarray:
    """Damped inverse document frequency of each cell: ``sqrt(ln(1 + N / df))`` over all rows."""

    def count(batches):
        total, rows = np.zeros(1 << CELL_BITS, np.int64), 0
        for batch in batches:
            offs, data = buffers(batch.column(0))
            rows += len(offs) - 1
            for a, b in steps(offs):
                _, ids, _ = shingle_ids(Words(data, offs[a:b + 1]))
                total += np.bincount(_cells(ids), minlength=len(total))
        cells = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(cells, -1)), pa.array(np.append(total[cells], rows))], ["cell", "n"])

    found = (docs.select(text_or_empty().alias("text")).mapInArrow(count, "cell long, n long")
             .groupBy("cell").agg(F.sum("n").alias("n")).toArrow())  # at most 2**18 + 1 rows
    cell, n = found["cell"].to_numpy(), found["n"].to_numpy()
    rows = int(n[cell < 0].sum())
    df = np.ones(1 << CELL_BITS)
    df[cell[cell >= 0]] = n[cell >= 0]
    return np.sqrt(np.log1p(max(rows, 1) / df)).astype(np.float32)


def _weights(ids: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """TF-IDF with a sublinear term frequency."""
    return (1.0 + np.log(counts)) * idf[_cells(ids)]


def _draws() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pool of 2**16 draws of (r, ln c, beta): r, c ~ Gamma(2, 1), beta ~ U(0, 1)."""
    g = np.random.Generator(np.random.PCG64(7))
    size = 1 << 16
    return (g.gamma(2.0, 1.0, size).astype(np.float32), np.log(g.gamma(2.0, 1.0, size)).astype(np.float32),
            g.random(size).astype(np.float32))


def band_hashes(first, ids, weight, bands=BANDS, rows=ROWS) -> np.ndarray:
    """(texts, bands) hashes of the consistent weighted samples; texts must have shingles."""
    r_of, lnc_of, beta_of = _draws()
    log_w = np.log(weight).astype(np.float32)
    sizes = np.diff(first)
    out = np.zeros((len(sizes), bands), np.uint64)
    for k in range(bands * rows):
        slot = (mix_seed(k) * (ids + _U(2 * k + 1))) >> _U(48)
        r, beta = r_of[slot], beta_of[slot]
        t = np.floor(log_w / r + beta)
        key = lnc_of[slot] - r * (t + 1 - beta)
        least = np.minimum.reduceat(key, first[:-1])
        hit = np.flatnonzero(key == np.repeat(least, sizes))
        hit = hit[np.searchsorted(hit, first[:-1])]  # first of equal keys: ids ascend in every text
        sample = mix(ids[hit] * _U(0x9E3779B97F4A7C15) + t[hit].astype(np.int64).astype(np.uint64) + _U(k))
        out[:, k // rows] = mix(out[:, k // rows] * _U(0xD6E8FEB86659FD93) + sample)
    return out


def mix_seed(k: int) -> np.uint64:
    """Odd 64-bit multiplier of sample k."""
    return mix(np.array([k + 1], np.uint64))[0] | _U(1)


def signatures(texts: DataFrame, weights, bands=BANDS, rows=ROWS) -> DataFrame:
    """(key, rid, total, bands): one row per input row that has words."""

    def sign(batches):
        idf = weights.value
        for batch in batches:
            offs, data = buffers(batch.column("text"))
            keep, totals, hashes = [], [], []
            for a, b in steps(offs):
                first, ids, counts = shingle_ids(Words(data, offs[a:b + 1]))
                some = np.flatnonzero(np.diff(first))
                if not len(some):
                    continue
                weight = _weights(ids, counts, idf)
                first = np.append(first[some], first[-1])  # empty texts take no ids
                keep.append(a + some)
                totals.append(np.add.reduceat(weight, first[:-1]))
                hashes.append(band_hashes(first, ids, weight, bands, rows))
            if keep:
                h = np.concatenate(hashes).view(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, h.size + 1, bands, dtype=np.int32)), pa.array(h.ravel()))
                at = pa.array(np.concatenate(keep))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("key").take(at), batch.column("rid").take(at), pa.array(np.concatenate(totals).astype(np.float64)), lists],
                    ["key", "rid", "total", "bands"])

    return texts.mapInArrow(sign, "key binary, rid long, total double, bands array<long>")


def exact_similarity(pairs: DataFrame, weights) -> DataFrame:
    """(a, b, similarity) of rows (a, b, text_a, text_b): the exact weighted Jaccard similarity, or
    the plain one where that is higher (the edits of a copy are rare shingles of high weight, so
    that in a large group of copies the weighted one alone would fall below the plain one)."""

    def compare(batches):
        idf = weights.value
        for batch in batches:
            (oa, da), (ob, db) = buffers(batch.column("text_a")), buffers(batch.column("text_b"))
            both = np.empty(len(oa), np.int64)
            both[:] = (oa - oa[0]) + (ob - ob[0])
            sims = []
            for s, e in steps(both, CHUNK_BYTES, 1 << 14):
                sides = []
                for offs, data in ((oa, da), (ob, db)):
                    first, ids, counts = shingle_ids(Words(data, offs[s:e + 1]))
                    pair = np.repeat(np.arange(e - s, dtype=np.uint64), np.diff(first))
                    sides.append(((pair << _U(ID_BITS)) | ids, _weights(ids, counts, idf)))
                key = np.concatenate([x[0] for x in sides])
                weight = np.concatenate([x[1] for x in sides])
                order = np.argsort(key, kind="stable")
                key, weight = key[order], weight[order]
                same = np.flatnonzero(key[1:] == key[:-1])
                pair = (key >> _U(ID_BITS)).astype(np.int64)
                shared = np.bincount(pair[same], np.minimum(weight[same], weight[same + 1]), e - s)
                total = np.bincount(pair, weight, e - s)
                weighted = np.divide(shared, total - shared, out=np.zeros(e - s), where=total > shared)
                both_n, all_n = np.bincount(pair[same], minlength=e - s), np.bincount(pair, minlength=e - s)
                plain = np.divide(both_n, all_n - both_n, out=np.zeros(e - s), where=all_n > both_n)
                sims.append(np.maximum(weighted, plain))
            if sims:
                yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(np.concatenate(sims))], ["a", "b", "similarity"])

    return pairs.select("a", "b", "text_a", "text_b").mapInArrow(compare, "a binary, b binary, similarity double")


def _verified(pairs: DataFrame, texts: DataFrame, weights, threshold: float) -> DataFrame:
    """Links among ``pairs`` (a, b, n).  ``a`` may have very many partners: its text is sent once
    for each block of partners, never once to one task for all of them."""
    pairs = (pairs.withColumn("blocks", F.ceil(F.col("n") / PAIRS_PER_BLOCK))
             .select("a", "b", F.expr("pmod(hash(b), blocks)").alias("block")))
    left = (pairs.select("a", "block").distinct()
            .join(texts.select(F.col("key").alias("a"), F.col("text").alias("text_a")), "a"))
    right = pairs.join(texts.select(F.col("key").alias("b"), F.col("text").alias("text_b")), "b")
    return exact_similarity(right.join(left, ["a", "block"]), weights).where(F.col("similarity") >= threshold)


def _shared_buckets(texts: DataFrame) -> DataFrame:
    """(band, hash, key, total, head, n) of the texts in buckets of more than one text.  ``head`` is the
    bucket's representative: the text of the least hashed key, the same one in all bands that a class
    of similar texts shares."""
    rows = texts.select("key", "total", F.xxhash64("key").alias("rank"), F.posexplode("bands").alias("band", "hash"))
    # a table of its own: joined straight from a shuffle, a bucket of very many texts can be split
    heads = staged(rows.groupBy("band", "hash").agg(F.min(F.struct("rank", "key")).alias("head"), F.count(F.lit(1)).alias("n"))
                   .where("n > 1").select("band", "hash", F.col("head.key").alias("head"), "n"), "heads")
    return rows.drop("rank").join(heads, ["band", "hash"])


def _unsettled(buckets: DataFrame, labels: DataFrame) -> DataFrame:
    """Members of the buckets that hold more than one class, with their class (``cls``), the
    bucket's largest class (``main``) and its number of members."""
    m = buckets.drop("head", "n").join(labels.withColumnsRenamed({"node": "key", "label": "cls"}), "key", "left").withColumn("cls", F.coalesce("cls", "key"))
    m = staged(m, "classed")
    per = m.groupBy("band", "hash", "cls").agg(F.count(F.lit(1)).alias("n"))
    split = staged(per.groupBy("band", "hash").agg(F.count(F.lit(1)).alias("classes"), F.max(F.struct("n", "cls")).alias("top"), F.sum("n").alias("members"))
                   .where("classes > 1").select("band", "hash", F.col("top.cls").alias("main"), "members"), "split-buckets")
    return staged(m.join(split, ["band", "hash"]), "unsettled")


def _probe_pairs(m: DataFrame, least_ratio: float, turn: int) -> DataFrame:
    """Each text outside its bucket's largest class with one member of that class, another one in
    each band and turn."""
    rank = F.xxhash64("key", "band", F.lit(turn))
    probe = (m.where("cls = main").groupBy("band", "hash").agg(F.min(F.struct(rank.alias("rank"), "key", "total")).alias("p"))
             .select("band", "hash", F.col("p.key").alias("a"), F.col("p.total").alias("total_a")))
    return (m.where("cls != main").join(probe, ["band", "hash"])
            .where(F.least("total", "total_a") >= least_ratio * F.greatest("total", "total_a"))
            .groupBy("a", F.col("key").alias("b")).agg(F.max("members").alias("n")))


def _dealt(side: DataFrame, group: list[str], other: str, own: str, rows: int) -> DataFrame:
    """``side`` dealt over tiles: its rows of a group go to ``ceil(n / rows)`` blocks by hash, and
    each row once to every block of the other side (column ``other``: that side's blocks)."""
    return (side.withColumn("_own", F.expr(f"pmod(xxhash64(key), ceil({own} / {rows}))"))
            .withColumn("_other", F.explode(F.expr(f"sequence(0L, CAST({other} AS BIGINT) - 1)"))))


def _tiles(m: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows (tile, side, key, cls): all that is still to be compared, in tiles of bounded size.

    A text outside its bucket's largest class meets all texts of that class (tiles by class: a text
    that meets the class in several bands is compared once), and the other texts outside it (tiles
    by bucket).  Rows grow with members times blocks, never with pairs."""
    out = m.where("cls != main")
    touch = out.select("key", F.col("cls").alias("own_cls"), F.col("main").alias("cls")).distinct()
    inside = (labels.select(F.col("node").alias("key"), F.col("label").alias("cls"))
              .unionByName(m.where("cls = main AND key = cls").select("key", "cls")).distinct()
              .join(touch.select("cls").distinct(), "cls", "left_semi"))
    n_u = touch.groupBy("cls").agg(F.count(F.lit(1)).alias("n_u"))
    sizes = inside.groupBy("cls").agg(F.count(F.lit(1)).alias("n_m")).join(n_u, "cls")
    left = _dealt(touch.join(sizes, "cls"), ["cls"], f"ceil(n_m / {TILE_INSIDE})", "n_u", TILE_OUTSIDE)
    right = _dealt(inside.join(sizes, "cls"), ["cls"], f"ceil(n_u / {TILE_OUTSIDE})", "n_m", TILE_INSIDE)
    name = lambda i, j: F.xxhash64(F.lit("class"), "cls", i, j).alias("tile")
    by_class = (left.select(name("_own", "_other"), F.lit(0).alias("side"), "key", F.col("own_cls").alias("cls"))
                .unionByName(right.select(name("_other", "_own"), F.lit(1).alias("side"), "key", "cls")))
    per = out.groupBy("band", "hash").agg(F.count(F.lit(1)).alias("n_o"), F.countDistinct("cls").alias("classes")).where("classes > 1")
    peers = out.join(per, ["band", "hash"])
    lists = [_dealt(peers, ["band", "hash"], f"ceil(n_o / {TILE_OUTSIDE})", "n_o", TILE_OUTSIDE) for _ in range(2)]
    by_bucket = None
    for side, (dealt, i, j) in enumerate(((lists[0], "_own", "_other"), (lists[1], "_other", "_own"))):
        rows = dealt.where(F.col(i) <= F.col(j)).select(F.xxhash64(F.lit("bucket"), "band", "hash", i, j).alias("tile"), F.lit(side).alias("side"), "key", "cls")
        by_bucket = rows if by_bucket is None else by_bucket.unionByName(rows)
    return by_class.unionByName(by_bucket)


def _tile_links(tiles: DataFrame, texts: DataFrame, weights, threshold: float) -> DataFrame:
    """Links (a, b) between the two sides of each tile, among texts of different classes."""

    def compare(group: pa.Table) -> pa.Table:
        idf, sides = weights.value, []
        for side in (0, 1):
            rows = group.filter(pa.compute.equal(group["side"], side))
            offs, data = buffers(rows["text"])
            first, ids, counts = [0], [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
            for s, e in steps(offs):
                f, i, c = shingle_ids(Words(data, offs[s:e + 1]))
                first.extend(f[1:] + first[-1])
                ids.append(i)
                counts.append(c)
            ids, counts, first = np.concatenate(ids), np.concatenate(counts), np.array(first)
            weight = _weights(ids, counts, idf)
            of = np.repeat(np.arange(len(rows)), np.diff(first))
            sides.append((rows, first, ids, weight, of, np.bincount(of, weight, len(rows))))
        (ra, _, ia, wa, oa, ta), (rb, fb, ib, wb, ob, tb) = sides
        order = np.argsort(ia, kind="stable")
        ia, wa, oa, na = ia[order], wa[order], oa[order], np.bincount(oa, minlength=len(ra))
        lo, hi = np.searchsorted(ia, ib, "left"), np.searchsorted(ia, ib, "right")
        hits = np.append(0, np.cumsum(hi - lo))
        cls_a, cls_b = (np.array(r["cls"].to_pylist(), dtype=object) for r in (ra, rb))
        key_a, key_b = ra["key"].to_pylist(), rb["key"].to_pylist()
        found = []
        j = 0
        while j < len(rb):  # texts of the second side, as many as have 2**20 shared shingles together
            k = max(j + 1, int(np.searchsorted(hits[fb], hits[fb[j]] + (1 << 20), "right")) - 1)
            s, e = fb[j], fb[k]
            n = hi[s:e] - lo[s:e]
            at = np.repeat(lo[s:e] - (hits[s:e] - hits[s]), n) + np.arange(hits[e] - hits[s])
            cell = oa[at] * (k - j) + np.repeat(ob[s:e] - j, n)
            low = np.bincount(cell, np.minimum(wa[at], np.repeat(wb[s:e], n)), len(ra) * (k - j)).reshape(len(ra), k - j)
            both = np.bincount(cell, minlength=len(ra) * (k - j)).reshape(len(ra), k - j)
            with np.errstate(divide="ignore", invalid="ignore"):
                sim = np.maximum(low / (ta[:, None] + tb[None, j:k] - low),
                                 both / (na[:, None] + np.diff(fb)[None, j:k] - both))
            for x, y in zip(*np.nonzero(sim >= threshold)):
                if cls_a[x] != cls_b[j + y]:
                    found.append((key_a[x], key_b[j + y]))
            j = k
        return pa.table({"a": pa.array([x[0] for x in found], pa.binary()), "b": pa.array([x[1] for x in found], pa.binary())})

    return tiles.join(texts, "key").groupBy("tile").applyInArrow(compare, "a binary, b binary")


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, ...): doc_id, class_id, class_size, kept,
    text_key (128-bit digest of the text), class_key (that of the kept row, also where doc_ids repeat).

    ``class_id`` is the least doc_id of the class; rows with equal texts are always in one class,
    and two texts are linked when their weighted (or plain) Jaccard similarity on five-word
    shingles is at least ``threshold``.  Exactly one row of a class has ``kept``: that of the least doc_id.

    A null text counts as empty.  Empty texts, and texts without a word, are in one class with
    equal texts only.  Texts of one to four words have one shingle of all their words.  A null
    doc_id orders after all others; repeated rows each give a row, of which one is kept.  Other
    columns are not read, whatever their names; an empty table gives an empty result."""
    spark = docs.sparkSession
    ship(spark)
    rows_in = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("rid"), text_or_empty().alias("text"))
    rows_in = rows_in.withColumn("key", text_key(F.col("text")))
    weights = spark.sparkContext.broadcast(cell_weights(docs))  # 2**18 floats

    # one row per text that has words: the row of least doc_id stands for its copies
    texts = staged(signatures(rows_in, weights, bands, rows).groupBy("key").agg(
        F.min("rid").alias("rid"), F.first("total").alias("total"), F.first("bands").alias("bands")), "signatures")
    buckets = staged(_shared_buckets(texts), "buckets")

    # the texts that share a bucket, the only ones that are compared: read once, found by key and row
    # id together, so that the copies of one text are dealt over many tasks (by a merge join at any
    # size, since the number of these texts grows with the corpus)
    wanted = staged(texts.select("key", "rid").join(buckets.select("key").distinct(), "key", "left_semi"), "wanted")
    bodies = staged(rows_in.join(wanted.hint("merge"), ["key", "rid"], "left_semi")
                    .groupBy("key", "rid").agg(F.first("text").alias("text")).drop("rid"), "texts")

    least_ratio = threshold * RATIO_SLACK
    stars = staged(buckets.where("key != head").groupBy(F.col("head").alias("a"), F.col("key").alias("b"))
                   .agg(F.max("n").alias("n")), "stars")
    checked = stars.select("a", "b")
    links = staged(_verified(stars, bodies, weights, threshold).select("a", "b"), "links")
    labels = connected_components(links)
    for turn in range(PROBE_TURNS):
        pairs = staged(_probe_pairs(_unsettled(buckets, labels), least_ratio, turn).join(checked, ["a", "b"], "left_anti"), "pairs")
        found = staged(_verified(pairs, bodies, weights, threshold).select("a", "b"), "links")
        checked, links = checked.unionByName(pairs.select("a", "b")), links.unionByName(found)
        labels = connected_components(links)
    tiles = staged(_tiles(_unsettled(buckets, labels), labels), "tiles")
    found = staged(_tile_links(tiles, bodies, weights, threshold), "links")
    if not found.isEmpty():
        labels = connected_components(links.unionByName(found))

    # equal rows are counted first, then the rows of a text and the texts of a class, so that
    # neither a text with many copies nor a class with many texts meets in one task
    members = staged(rows_in.groupBy("key", "rid").agg(F.count(F.lit(1)).alias("times")), "members")
    per_text = members.groupBy("key").agg(F.min("rid").alias("least"), F.sum("times").alias("n"))
    per_text = staged(per_text.join(labels.withColumnsRenamed({"node": "key", "label": "cls"}), "key", "left")
                      .withColumn("cls", F.coalesce("cls", "key")), "per-text")
    per_class = per_text.groupBy("cls").agg(F.min(F.struct("least", "key")).alias("head"), F.sum("n").alias("class_size"))
    shared = staged(per_text.join(per_class.where("class_size > 1"), "cls")
                    .select("key", "class_size", F.col("head.least").alias("class_rid"), F.col("head.key").alias("head_key")), "classes")
    out = members.join(shared, "key", "left").select(
        "key", "rid", F.coalesce("head_key", "key").alias("class_key"), F.coalesce("class_rid", "rid").alias("class_rid"), F.coalesce("class_size", F.lit(1)).alias("class_size"),
        (F.col("class_size").isNull() | ((F.col("key") == F.col("head_key")) & (F.col("rid") == F.col("class_rid")))).alias("head"),
        F.posexplode(F.expr("array_repeat(0, CAST(times AS INT))")).alias("nth", "_"))
    return out.select(F.nullif("rid", F.lit(NO_ID)).alias("doc_id"), F.nullif("class_rid", F.lit(NO_ID)).alias("class_id"),
                      "class_size", (F.col("head") & (F.col("nth") == 0)).alias("kept"), F.col("key").alias("text_key"), "class_key")


def keep_one_per_class(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without all but one row of each near-duplicate class (the least doc_id stays)."""
    kept = near_duplicates(docs, threshold).where("kept").select(F.coalesce("doc_id", F.lit(NO_ID)).alias("rid"), F.col("text_key").alias("key"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
                       F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("rid"), text_key(text_or_empty()).alias("key"))
    one = rows.join(kept, ["rid", "key"], "left_semi").dropDuplicates(["rid", "key"])
    return one.select(*[F.col("row")[c].alias(c) for c in docs.columns])
