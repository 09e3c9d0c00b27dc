"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

The score is ``sigmoid(w0 + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j)``; the pairwise part is
``(|sum_i v_i x_i|^2 - sum_i |v_i|^2 x_i^2) / 2`` and so linear in the number of features.  Features:

* hashed words: the share of each of ``WORD_CELLS`` cells among the words, as its square root;
* structure statistics (letters, capitals, digits, marks, words, repeats, lines), each cut into
  ``BINS`` bins at the quantiles of the training sample;
* metadata: the character count that the row states (``n_chars``), cut likewise.

The machine is fitted by mini-batch Adagrad in one task on a sample of at most ``SAMPLE`` labelled
rows (those of least hashed doc_id); scoring streams over all rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import ship, text_or_empty
from .vectext import Words, buffers, mix, steps

#: Bound of the training sample, in rows.
SAMPLE = 8192
WORD_CELLS = 1 << 11
BINS = 12
FACTORS = 8
EPOCHS = 15
BATCH = 128
THRESHOLD = 0.7
_U = np.uint64
_MARKS = b"!*#|$%&<>{}[]=_\\/"


def statistics(data: np.ndarray, offs: np.ndarray, stated: np.ndarray) -> tuple[np.ndarray, Words]:
    """(texts, statistics) of one step of texts, and its words."""
    w = Words(data, offs)
    raw, offs, n = w.raw, w.offs, len(offs) - 1
    size = np.diff(offs).astype(float)
    some = np.maximum(size, 1)

    def share(mask):
        return np.diff(np.concatenate(([0], np.cumsum(mask, dtype=np.int64)))[offs]) / some

    n_words = np.diff(w.first).astype(float)
    words = np.maximum(n_words, 1)
    of = np.repeat(np.arange(n, dtype=np.uint64), np.diff(w.first))
    key = np.sort((of << _U(48)) | (w.hash >> _U(16)))
    at = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
    times = np.diff(np.append(at, len(key)))
    doc = (key[at] >> _U(48)).astype(np.int64)
    distinct = np.bincount(doc, minlength=n)
    most = np.zeros(n)
    np.maximum.at(most, doc, times)
    again = np.zeros(len(w.hash) + 1, np.int64)
    if len(w.hash) > 1:
        same = (w.hash[1:] == w.hash[:-1]) & (of[1:] == of[:-1])
        again[2:] = np.cumsum(same)
    repeats = again[w.first[1:]] - again[np.minimum(w.first[:-1] + 1, w.first[1:])]
    lengths = np.concatenate(([0], np.cumsum(w.end - w.start)))
    lines = share(raw == 10) * some + 1
    stop = (raw == 46) | (raw == 63)
    stats = [np.log1p(size), np.log1p(n_words), share((raw >= 65) & (raw <= 90)), share((raw >= 48) & (raw <= 57)), share(raw >= 128),
             share(stop), share(raw == 44), share((raw == 32) | (raw == 10)), np.log1p(lines), np.log1p(n_words / lines),
             (lengths[w.first[1:]] - lengths[w.first[:-1]]) / words, distinct / words, most / words, repeats / words]
    stats += [share(raw == c) for c in _MARKS[:9]] + [share(np.isin(raw, np.frombuffer(_MARKS, np.uint8)))]
    stats.append(np.log1p(np.maximum(np.where(np.isnan(stated), size, stated), 0)))
    return np.column_stack(stats), w


N_STATS = 14 + 9 + 1 + 1


def word_cells(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, cell, value) of the hashed words of a step."""
    n = len(w.first) - 1
    of = np.repeat(np.arange(n, dtype=np.int64), np.diff(w.first))
    key = np.sort(of * WORD_CELLS + (mix(w.hash) >> _U(64 - 11)).astype(np.int64))
    at = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
    times = np.diff(np.append(at, len(key)))
    text = key[at] // WORD_CELLS
    return text, key[at] % WORD_CELLS, np.sqrt(times / np.maximum(np.diff(w.first), 1)[text])


class Machine:
    """Weights of a factorisation machine; ``edges``: (statistics, BINS - 1) cuts of the bins."""

    def __init__(self, edges, w0, w, v):
        self.edges, self.w0, self.w, self.v = edges, w0, w, v

    def bins(self, stats: np.ndarray) -> np.ndarray:
        """Feature numbers of the bins that hold each statistic."""
        cols = [np.searchsorted(self.edges[j], stats[:, j], side="right") for j in range(stats.shape[1])]
        return WORD_CELLS + np.column_stack(cols) + np.arange(stats.shape[1]) * BINS

    def score(self, data, offs, stated) -> np.ndarray:
        stats, w = statistics(data, offs, stated)
        text, cell, value = word_cells(w)
        bins = self.bins(stats)
        n, k = bins.shape
        linear = np.bincount(text, value * self.w[cell], n) + self.w[bins].sum(axis=1)
        pair = np.zeros(n)
        for f in range(self.v.shape[1]):
            v = self.v[:, f]
            s = np.bincount(text, value * v[cell], n) + v[bins].sum(axis=1)
            q = np.bincount(text, (value * v[cell]) ** 2, n) + (v[bins] ** 2).sum(axis=1)
            pair += s * s - q
        return 1 / (1 + np.exp(-np.clip(self.w0 + linear + pair / 2, -30, 30)))


def fit_machine(data, offs, stated, label) -> Machine:
    """Adagrad on the log loss, with a fixed order of the rows."""
    stats, cells = [], []
    for a, b in steps(offs):
        s, w = statistics(data, offs[a:b + 1], stated[a:b])
        text, cell, value = word_cells(w)
        stats.append(s)
        cells.append((text + a, cell, value))
    stats = np.concatenate(stats)
    text, cell, value = (np.concatenate(x) for x in zip(*cells))
    edges = np.quantile(stats, np.arange(1, BINS) / BINS, axis=0).T
    size = WORD_CELLS + N_STATS * BINS
    rng = np.random.Generator(np.random.PCG64(11))
    m = Machine(edges, 0.0, np.zeros(size, np.float32), rng.normal(0, 0.02, (size, FACTORS)).astype(np.float32))
    bins = m.bins(stats)
    first = np.searchsorted(text, np.arange(len(label) + 1))
    g_w, g_v, g_0 = np.full(size, 1e-6, np.float32), np.full((size, FACTORS), 1e-6, np.float32), 1e-6
    decay = np.full(size, 1e-4, np.float32)
    decay[:WORD_CELLS] = 1e-3
    for epoch in range(EPOCHS):
        order = rng.permutation(len(label))
        for at in range(0, len(order), BATCH):
            rows = order[at:at + BATCH]
            x = np.zeros((len(rows), size), np.float32)
            for i, r in enumerate(rows):
                s, e = first[r], first[r + 1]
                x[i, cell[s:e]] = value[s:e]
                x[i, bins[r]] = 1
            xv, x2 = x @ m.v, x * x
            z = m.w0 + x @ m.w + ((xv ** 2).sum(1) - x2 @ (m.v ** 2).sum(1)) / 2
            err = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - label[rows]).astype(np.float32) / len(rows)
            d_w = x.T @ err + decay * m.w
            d_v = x.T @ (err[:, None] * xv) - (x2.T @ err)[:, None] * m.v + decay[:, None] * m.v
            d_0 = float(err.sum())
            g_w += d_w ** 2
            g_v += d_v ** 2
            g_0 += d_0 ** 2
            rate = 0.1
            m.w -= rate * d_w / np.sqrt(g_w)
            m.v -= rate / 4 * d_v / np.sqrt(g_v)
            m.w0 -= rate * d_0 / g_0 ** 0.5
    return m


def _stated(col) -> np.ndarray:
    return col.cast(pa.float64()).to_numpy(zero_copy_only=False)


def _with_stated(docs: DataFrame) -> DataFrame:
    n = F.col("n_chars").cast("double") if "n_chars" in docs.columns else F.lit(None).cast("double")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"), n.alias("n_chars"))


def held_out(doc_id) -> F.Column:
    """Rows that are never trained on: crc32 of the doc_id as text, modulo 4, is 2."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Machine | None:
    """A machine fitted on at most ``sample`` labelled rows that aren't held out (those of least
    hashed doc_id, so the same ones whatever the partitions); None without any.  A doc_id with
    several labels has the least of them; of several rows of a doc_id each one counts."""
    ship(docs.sparkSession)
    picked = (labels.where("quality IS NOT NULL AND doc_id IS NOT NULL")
              .select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("double").alias("quality"))
              .where(~held_out("doc_id")).groupBy("doc_id").agg(F.min("quality").alias("quality"))
              .orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(sample))
    rows = _with_stated(docs).join(F.broadcast(picked), "doc_id")  # at most ``sample`` rows

    def fit(group: pa.Table) -> pa.Table:
        group = group.sort_by([("doc_id", "ascending"), ("text", "ascending")])
        offs, data = buffers(group["text"])
        m = fit_machine(data, offs, _stated(group["n_chars"].combine_chunks()), (group["quality"].to_numpy() >= 0.5).astype(np.float32))
        parts = [m.edges.astype(np.float64), np.array([m.w0]), m.w.astype(np.float64), m.v.astype(np.float64)]
        return pa.table({"part": pa.array(range(4), pa.int32()), "body": pa.array([p.tobytes() for p in parts], pa.binary())})

    got = {r.part: np.frombuffer(r.body) for r in rows.groupBy(F.lit(0).alias("all")).applyInArrow(fit, "part int, body binary").collect()}
    if not got:
        return None
    return Machine(got[0].reshape(N_STATS, BINS - 1), got[1][0], got[2], got[3].reshape(-1, FACTORS))


def quality_scores(docs: DataFrame, machine: Machine | None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``docs`` (doc_id, text, n_chars, ...).

    Whole texts are read.  A null text counts as empty, a null or missing n_chars as the text's own
    length; empty texts are scored by their (empty) statistics.  A null doc_id stays null and counts
    as not held out; repeated rows give a row each; without a machine every score is 0.5; columns
    other than doc_id, text and n_chars are not read; an empty table gives an empty result."""
    spark = docs.sparkSession
    ship(spark)
    model = spark.sparkContext.broadcast(machine)  # of fixed size

    def score(batches):
        m = model.value
        for batch in batches:
            offs, data = buffers(batch.column("text"))
            stated = _stated(batch.column("n_chars"))
            got = [np.full(b - a, 0.5) if m is None else m.score(data, offs[a:b + 1], stated[a:b]) for a, b in steps(offs)]
            s = np.concatenate(got) if got else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    scored = _with_stated(docs).mapInArrow(score, "doc_id long, score double, predicted int")
    return scored.select("doc_id", F.coalesce(held_out("doc_id"), F.lit(False)).alias("held_out"), "score", "predicted")


def keep_good(docs: DataFrame, machine: Machine | None, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose score is at least ``threshold``."""
    spark = docs.sparkSession
    ship(spark)
    model = spark.sparkContext.broadcast(machine)
    if machine is None:
        return docs

    def keep(batches):
        for batch in batches:
            text = batch.column(batch.schema.get_field_index("text")).cast(pa.string())
            offs, data = buffers(text)
            at = batch.schema.get_field_index("n_chars")
            stated = _stated(batch.column(at)) if at >= 0 else np.full(len(text), np.nan)
            got = [model.value.score(data, offs[a:b + 1], stated[a:b]) >= threshold for a, b in steps(offs)]
            if got:
                yield batch.filter(pa.array(np.concatenate(got)))

    return docs.mapInArrow(keep, docs.schema)
