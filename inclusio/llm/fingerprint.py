"""Document fingerprints: quartile bucket digests of hashed byte triplets.

Every window of five bytes gives up to six triplets that hold its first byte.  Each triplet is
hashed into one of 256 buckets; a bucket is encoded by the quartile of all buckets that its count
is in (two bits).  A header encodes the length (logarithmic) and two ratios of the quartiles.  Two
digests are compared by a difference score of header and buckets, bounded to a likeness in [0, 1].
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import CHUNK_BYTES, ship, staged, text_or_empty

BUCKETS = 256
#: Byte offsets of the triplets that start at a byte.
TRIPLETS = ((0, 1, 2), (0, 1, 3), (0, 2, 3), (0, 1, 4), (0, 2, 4), (0, 3, 4))
HEADER = 3
#: Differences from here on are a likeness of 0.
FARTHEST = 512
_STEP = np.array([0, 1, 2, 6])  # of two buckets whose quartiles are so far apart
_HEADER_WEIGHT = np.array([12, 2, 2])


def digests(texts: list[bytes]) -> np.ndarray:
    """(n, HEADER + BUCKETS / 4) digest bytes of each text."""
    out = np.zeros((len(texts), HEADER + BUCKETS // 4), np.uint8)
    a = 0
    sizes = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(sizes)
    while a < len(texts):
        before = ends[a - 1] if a else 0
        b = max(a + 1, int(np.searchsorted(ends, before + CHUNK_BYTES, side="right")))
        data = np.frombuffer(b"".join(texts[a:b]), np.uint8).astype(np.uint32)
        counts = np.zeros((b - a, BUCKETS), np.int64)
        cuts = ends[a:b] - before
        for k, (_, y, z) in enumerate(TRIPLETS):
            if len(data) <= z:
                continue
            n = len(data) - z
            h = data[:n] * np.uint32(0x9E3779B1) + data[y:y + n] * np.uint32(0x85EBCA77) + data[z:z + n] * np.uint32(0xC2B2AE3D) + np.uint32(k * 0x27D4EB2F)
            h ^= h >> np.uint32(15)
            bucket = ((h * np.uint32(0x2C1B3C6D)) >> np.uint32(24)).astype(np.uint8)
            start = 0
            for i, end in enumerate(cuts):
                if end - z > start:
                    counts[i] += np.bincount(bucket[start:end - z], minlength=BUCKETS)
                start = end
        out[a:b] = _encode(counts, sizes[a:b])
        a = b
    return out


def _encode(counts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    ordered = np.sort(counts, axis=1)
    q1, q2, q3 = (ordered[:, BUCKETS * k // 4 - 1, None] for k in (1, 2, 3))
    code = ((counts > q1).astype(np.uint8) + (counts > q2) + (counts > q3)).reshape(len(counts), -1, 4)
    body = code[:, :, 0] | code[:, :, 1] << 2 | code[:, :, 2] << 4 | code[:, :, 3] << 6
    length = np.minimum(np.floor(np.log1p(sizes) / np.log(1.15)), 255)
    ratio = [np.floor(16 * q[:, 0] / np.maximum(q3[:, 0], 1)).astype(int) for q in (q1, q2)]
    return np.column_stack([length, *ratio, body]).astype(np.uint8)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """1 for equal digests, less by the difference score, 0 from ``FARTHEST`` on."""
    head = np.minimum(np.abs(a[:, :HEADER].astype(int) - b[:, :HEADER]), 8) @ _HEADER_WEIGHT
    body = np.zeros(len(a), int)
    for shift in (0, 2, 4, 6):
        body += _STEP[np.abs(((a[:, HEADER:] >> shift) & 3).astype(int) - ((b[:, HEADER:] >> shift) & 3))].sum(axis=1)
    return np.maximum(0.0, 1.0 - (head + body) / FARTHEST)


def _rows(docs: list[tuple], followers: list[tuple]) -> dict:
    """Result columns of each (doc_id, text, digest) with the document that follows it."""
    edited = []
    for (_, text, _), (_, after, _) in zip(docs, followers):
        half = len(text) // 2
        edited.append((text[:len(text) - half] + after[:half]).encode())
    own, nxt = np.stack([d[2] for d in docs]), np.stack([d[2] for d in followers])
    ed = digests(edited)
    return {"doc_id": [d[0] for d in docs], "n_chars": [len(d[1]) for d in docs],
            "edited_sha256": [hashlib.sha256(e).hexdigest() for e in edited],
            "fingerprint": [x.tobytes().hex() for x in own], "edited_fingerprint": [x.tobytes().hex() for x in ed],
            "near_edited": likeness(own, ed), "near_next": likeness(own, nxt)}


_RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_EMPTY = {"doc_id": None, "n_chars": None, "edited_sha256": None, "fingerprint": None, "edited_fingerprint": None, "near_edited": None, "near_next": None}


def _schema(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}
    return pa.schema([(n, kinds[k]) for n, k in (x.split() for x in ddl.split(", "))])


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and of its edited text, for every row of ``docs`` (doc_id, text, ...).

    The documents are ordered by descending doc_id (nulls last; rows of equal doc_id by text); the
    edited text of a document has its last ``floor(n / 2)`` code points replaced by as many from the
    start of the document that follows it (the first follows the last).  Columns: doc_id, n_chars,
    edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The rows are sorted by range, so that each task streams a run of neighbours; only the first and
    last document of each run are joined over the run's border.  A null text counts as empty; a lone
    document follows itself; columns other than doc_id and text are not read; an empty table gives an
    empty result."""
    spark = docs.sparkSession
    ship(spark)
    full = "run long, kind string, text string, " + _RESULT

    def stream(batches):
        run, schema = TaskContext.get().partitionId(), _schema(full)
        last = None
        for batch in batches:
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            if not ids:
                continue
            here = list(zip(ids, texts, digests([t.encode() for t in texts])))
            if last is None:
                head = here[0]
                yield pa.RecordBatch.from_pylist([_EMPTY | {"run": run, "kind": "head", "text": head[1], "fingerprint": head[2].tobytes().hex()}], schema)
            line = here if last is None else [last, *here]
            if len(line) > 1:
                got = _rows(line[:-1], line[1:])
                n = len(line) - 1
                yield pa.RecordBatch.from_pydict(got | {"run": [run] * n, "kind": ["row"] * n, "text": [None] * n}, schema)
            last = line[-1]
        if last is not None:
            yield pa.RecordBatch.from_pylist([_EMPTY | {"run": run, "kind": "tail", "doc_id": last[0], "text": last[1], "fingerprint": last[2].tobytes().hex()}], schema)

    ordered = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
               .repartitionByRange(F.desc_nulls_last("doc_id")).sortWithinPartitions(F.desc_nulls_last("doc_id"), "text"))
    parts = staged(ordered.mapInArrow(stream, full), "fingerprints")

    runs = [r.run for r in parts.where("kind = 'head'").select("run").orderBy("run").collect()]  # one a partition
    after = spark.createDataFrame(list(zip(runs, runs[1:] + runs[:1])), "run long, next_run long")
    borders = (parts.where("kind = 'tail'").select("run", "doc_id", "text", "fingerprint").join(after, "run")
               .join(parts.where("kind = 'head'").select(F.col("run").alias("next_run"), F.col("text").alias("next_text"), F.col("fingerprint").alias("next_fp")), "next_run")
               .select("doc_id", "text", "fingerprint", "next_text", "next_fp"))

    def join_borders(batches):
        schema = _schema(_RESULT)
        code = lambda s: np.frombuffer(bytes.fromhex(s), np.uint8)
        for batch in batches:
            rows = batch.to_pylist()
            if rows:
                yield pa.RecordBatch.from_pydict(_rows([(r["doc_id"], r["text"], code(r["fingerprint"])) for r in rows],
                                                       [(None, r["next_text"], code(r["next_fp"])) for r in rows]), schema)

    names = [x.split()[0] for x in _RESULT.split(", ")]
    return parts.where("kind = 'row'").select(*names).unionByName(borders.mapInArrow(join_borders, _RESULT))
