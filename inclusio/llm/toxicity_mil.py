"""Toxicity by multiple-instance learning: documents are bags of sentences, labels stand on the bags.

A sentence's probability is ``sigmoid(bias + sum of weights of its signs)``; a document's is the noisy-or
``1 - prod(1 - p)`` over its sentences.  Signs are words and word beginnings of ``PREFIXES`` bytes, taken
from the training sample: those that stand in different sentences of toxic documents far more often than
these sentences' share of all would explain (``LEAST_RATIO``: log likelihood ratio; repeated sentences count
once, so copies of a document prove nothing).  A sentence without signs has probability 0, so the length of
a document says nothing.  The weights are fitted on the documents' labels alone, by gradient steps on the
noisy-or's log loss with an L1 penalty; the sentence probabilities then tell where the toxicity stands.

Words are found in blocks of bytes, and a bit map keeps nearly all of them from the search of the signs, so
a text of any length is read whole in bounded memory.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import ship, text_or_empty
from .terms import Lookup, blocks
from .vectext import buffers

#: Bounds of the training sample: labelled rows, and the bytes of a text that may be one of them.
SAMPLE = 8192
SAMPLE_BYTES = 1 << 15
PREFIXES = (4, 5, 6, 7, 8)
#: Longer words, in bytes, are signs by their beginnings only.
LONGEST = 64
LEAST_RATIO = 8.0
MOST_SIGNS = 1 << 15
STEPS = 400
RATE = 0.05
#: Penalty of a unit of weight, in documents.
PENALTY = 0.5
THRESHOLD = 0.5
_ENDS = np.isin(np.arange(256), np.frombuffer(b".!?\n", np.uint8))


def sentence_terms(data: np.ndarray, offs: np.ndarray):
    """(block, sentence of each term) over a column's buffer.  Sentences are numbered through the column;
    one ends with its text or after a full stop, exclamation mark, question mark or line break."""
    number = 0
    for b in blocks(data, offs, LONGEST):
        new = np.zeros(b.width, bool)
        new[1:] = _ENDS[data[b.base:b.base + b.width - 1]]
        new[0] = b.base > offs[0] and _ENDS[data[b.base - 1]]
        new[offs[np.searchsorted(offs, b.base):np.searchsorted(offs, b.base + b.width)] - b.base] = True
        run = np.cumsum(new) + number
        number = int(run[-1])
        yield b, run[b.start]


def _hashes(block):
    return [block.hashes(), *[block.prefix_hashes(k) for k in PREFIXES]]


class Model:
    """Sign hashes with their weights, and the bias."""

    def __init__(self, signs: np.ndarray, weights: np.ndarray, bias: float):
        self.signs, self.weights, self.bias = signs, weights, bias
        self.lookup = Lookup(signs)

    def sentences(self, texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, byte position of a sign, probability) of each sentence with a sign."""
        offs, data = buffers(texts)
        found = [(np.zeros(0, np.int64),) * 4]
        for b, sentence in sentence_terms(data, offs):
            for h in _hashes(b):
                at, sign = self.lookup.find(h)
                found.append((sentence[at], sign, b.text[at], b.at[at]))
        sentence, sign, text, at = (np.concatenate(x) for x in zip(*found))
        _, once = np.unique(sentence * len(self.signs) + sign, return_index=True)  # a sign counts once a sentence
        sentence, sign, text, at = sentence[once], sign[once], text[once], at[once]
        _, first, which = np.unique(sentence, return_index=True, return_inverse=True)
        z = self.bias + np.bincount(which, self.weights[sign], len(first))
        return text[first], at[first], 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def noisy_or(text: np.ndarray, p: np.ndarray, n: int) -> np.ndarray:
    return -np.expm1(np.bincount(text, np.log1p(-np.minimum(p, 1 - 1e-12)), n))


def _distinct(key: np.ndarray) -> np.ndarray:
    return np.unique(key, return_index=True)[1]


def fit_model(texts, label: np.ndarray) -> Model | None:
    """Signs and weights from texts and 0/1 labels; None if no sign stands out."""
    offs, data = buffers(texts)
    sentence, of, body = _bodies(data, offs)
    if not len(sentence):
        return None
    first = _distinct(body)
    fresh = np.zeros(int(sentence[-1]) + 1, bool)
    fresh[sentence[first]] = True
    share = np.bincount(of[first], minlength=len(label)) / np.maximum(np.bincount(of, minlength=len(label)), 1)
    use = share >= 0.5  # later copies of a document are left out of the fit
    chance = np.mean(label[of[first]] > 0)

    signs = [np.zeros(0, np.uint64)]
    for b, line in sentence_terms(data, offs):
        on = fresh[line] & (label[b.text] > 0)
        signs.append(np.unique(np.concatenate([h[on] for h in _hashes(b)])))
    signs = np.unique(np.concatenate(signs))
    signs = signs[signs != 0]
    if not len(signs):
        return None
    lookup, total, bad = Lookup(signs), np.zeros(len(signs)), np.zeros(len(signs))
    for b, line in sentence_terms(data, offs):
        at, number = (np.concatenate(x) for x in zip(*map(lookup.find, _hashes(b))))
        on = fresh[line[at]]
        at, number = at[on], number[on]
        once = _distinct(line[at] * len(signs) + number)
        total += np.bincount(number[once], minlength=len(signs))
        bad += np.bincount(number[once], label[b.text[at[once]]] > 0, len(signs))
    ratio = np.where(bad > 2 * chance * total, bad * np.log(np.maximum(bad, 1) / np.maximum(chance * total, 1e-12)), 0)
    picked = np.sort(np.argsort(-ratio, kind="stable")[:MOST_SIGNS])
    signs = signs[picked[ratio[picked] >= LEAST_RATIO]]
    if not len(signs):
        return None

    text, _, row, col = _instances(data, offs, signs)
    kept = use[text]
    doc, inverse = np.unique(text[kept], return_inverse=True)
    renumber = np.cumsum(kept) - 1
    on = kept[row]
    weights, bias = _descend(renumber[row[on]], col[on], inverse, label[doc] > 0, len(signs), int(use.sum()))
    return Model(signs[weights > 0], weights[weights > 0], bias) if (weights > 0).any() else None


def _bodies(data, offs):
    """(sentence, its text, hash of its words) of each sentence with a word."""
    parts = []
    for b, line in sentence_terms(data, offs):
        number, first, which = np.unique(line, return_index=True, return_inverse=True)
        body = np.zeros(len(number), np.uint64)
        np.add.at(body, which, b.hashes())
        parts.append((number, b.text[first], body))
    if not parts:
        return (np.zeros(0, np.int64),) * 3
    line, text, body = (np.concatenate(x) for x in zip(*parts))
    number, first, which = np.unique(line, return_index=True, return_inverse=True)  # a sentence may stand in two blocks
    whole = np.zeros(len(number), np.uint64)
    np.add.at(whole, which, body)
    return number, text[first], whole


def _instances(data, offs, signs):
    """(text of each sentence with signs, its number, and (row, sign) pairs, once each)."""
    lookup = Lookup(signs)
    found = []
    for b, sentence in sentence_terms(data, offs):
        for h in _hashes(b):
            at, s = lookup.find(h)
            found.append((sentence[at], s, b.text[at]))
    sentence, s, text = (np.concatenate(x) for x in zip(*found))
    once = _distinct(sentence * len(signs) + s)
    number, first, row = np.unique(sentence[once], return_index=True, return_inverse=True)
    return text[once][first], number, row, s[once]


def _descend(row, col, doc, label, n_signs, n_docs):
    """Adam on the noisy-or's log loss; weights stay at or above 0, those of no use end at 0."""
    w, bias = np.full(n_signs, 0.5), -3.0
    n_rows, n = len(doc), len(label)
    m, v = np.zeros(n_signs + 1), np.zeros(n_signs + 1)
    for t in range(1, STEPS + 1):
        z = bias + np.bincount(row, w[col], n_rows)
        p = 1 / (1 + np.exp(-np.clip(z, -50, 50)))
        good = np.exp(np.bincount(doc, -np.logaddexp(0, z), n))  # probability that no sentence is toxic
        pull = np.where(label, -good / np.maximum(1 - good, 1e-3), 1.0)
        d_z = p * pull[doc]
        g = np.append(np.bincount(col, d_z[row], n_signs) + PENALTY, d_z.sum()) / n_docs
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = RATE * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
        w = np.maximum(w - step[:-1], 0)
        bias = min(bias - step[-1], 0.0)
    return np.where(w > 0.05, w, 0.0), float(bias)


def held_out(doc_id: str) -> Column:
    """Rows that are never trained on: crc32 of the doc_id as text, modulo 5, is 0."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))


def sample_rows(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, text, toxic) of at most ``sample`` labelled rows that aren't held out and whose texts have at
    most ``SAMPLE_BYTES`` bytes: those of least hashed doc_id and text, the same ones whatever the partitions.
    They are counted after the join, so that a repeated doc_id doesn't add rows.  A doc_id with several labels
    is toxic if one of them is."""
    picked = (labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL")
              .select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("double").alias("toxic"))
              .where(~held_out("doc_id")).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
              .orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(sample))
    return (_texts(docs).where(F.octet_length("text") <= SAMPLE_BYTES).join(F.broadcast(picked), "doc_id")  # at most ``sample`` rows
            .orderBy(F.md5(F.col("doc_id").cast("string")), F.md5("text")).limit(sample))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model | None:
    """A model fitted on ``sample_rows``; None if there are no such rows or no sign stands out."""
    ship(docs.sparkSession)

    def fit(group: pa.Table) -> pa.Table:
        group = group.sort_by([("doc_id", "ascending"), ("text", "ascending")])
        model = fit_model(group["text"], (group["toxic"].to_numpy() >= 0.5).astype(np.int64))
        parts = [] if model is None else [model.signs, model.weights, np.array([model.bias])]
        return pa.table({"part": pa.array(range(len(parts)), pa.int32()), "body": pa.array([p.tobytes() for p in parts], pa.binary())})

    rows = sample_rows(docs, labels, sample).groupBy(F.lit(0).alias("all"))
    got = {r.part: r.body for r in rows.applyInArrow(fit, "part int, body binary").collect()}  # signs and weights
    if not got:
        return None
    return Model(np.frombuffer(got[0], np.uint64), np.frombuffer(got[1]), float(np.frombuffer(got[2])[0]))


def _extent(data, lo: int, hi: int, at: int) -> tuple[int, int]:
    """Bytes of the sentence, its mark included, that byte ``at`` of the text ``lo:hi`` stands in."""
    start, end, step = at, at, 4096
    while start > lo:
        near = np.flatnonzero(_ENDS[data[max(lo, start - step):start]])
        if len(near):
            start = max(lo, start - step) + int(near[-1]) + 1
            break
        start = max(lo, start - step)
    while end < hi:
        near = np.flatnonzero(_ENDS[data[end:min(hi, end + step)]])
        if len(near):
            end += int(near[0]) + 1
            break
        end = min(hi, end + step)
    while start < at and data[start] in b" \t\r\n":
        start += 1
    return start, end


def _locate(texts, text, at, p, least):
    """For each text the list of its sentences of probability ``least`` or more, in order, with code point
    positions."""
    offs, data = buffers(texts)
    out = [[] for _ in range(len(texts))]
    order = np.argsort(at, kind="stable")
    last, chars, upto = -1, 0, 0
    for i in order[p[order] >= least]:
        t = int(text[i])
        lo, hi = int(offs[t]), int(offs[t + 1])
        if t != last:
            last, chars, upto = t, 0, lo
        start, end = _extent(data, lo, hi, int(at[i]))
        begin = chars + int(np.count_nonzero((data[upto:start] & 0xC0) != 0x80))
        stop = begin + int(np.count_nonzero((data[start:end] & 0xC0) != 0x80))
        out[t].append({"start": begin, "end": stop, "score": float(p[i]), "sentence": data[start:end].tobytes().decode()})
        chars, upto = stop, end
    return out


SCORES = "doc_id long, score double, predicted int, sentences array<struct<start: long, end: long, score: double, sentence: string>>"


def toxicity(docs: DataFrame, model: Model | None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted, sentences of every row of ``docs`` (doc_id, text, ...).

    ``sentences`` are the offending ones (probability of ``threshold`` or more), in order: start and end in
    code points, probability, and the sentence itself.  Whole texts are read, however long; a null, empty or
    wordless text scores 0, as all rows do without a model.  A null doc_id stays null and counts as not held
    out; repeated rows give a row each; other columns are not read; an empty table gives an empty result."""
    spark = docs.sparkSession
    ship(spark)
    held = spark.sparkContext.broadcast(model)  # at most MOST_SIGNS signs

    def score(batches):
        m = held.value
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("sentence", pa.string())]))
        for batch in batches:
            texts, n = batch.column("text"), batch.num_rows
            if m is None:
                scores, where = np.zeros(n), [[]] * n
            else:
                text, at, p = m.sentences(texts)
                scores, where = noisy_or(text, p, n), _locate(texts, text, at, p, threshold)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores), pa.array((scores >= threshold).astype(np.int32)), pa.array(where, kind)],
                                             ["doc_id", "score", "predicted", "sentences"])

    return _texts(docs).mapInArrow(score, SCORES).select(
        "doc_id", F.coalesce(held_out("doc_id"), F.lit(False)).alias("held_out"), "score", "predicted", "sentences")


def offending_sentences(docs: DataFrame, model: Model | None, threshold: float = THRESHOLD) -> DataFrame:
    """One row for each offending sentence of ``docs``: doc_id, start, end, score, sentence."""
    return toxicity(docs, model, threshold).select("doc_id", F.explode("sentences").alias("s")).select("doc_id", "s.*")
