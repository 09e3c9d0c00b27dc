"""Token counts: byte-pair merging of many pre-tokens at once, on ragged numpy arrays.

A word-end vocabulary (``word_bpe_49k.json``) splits a text in three steps: special strings are cut
out, the rest is normalised (NFC, white space, lower case) and cut into pre-tokens, and each
pre-token, as a row of byte symbols of which the last carries the word end, is merged by rank.
Here all pre-tokens of a step that were not seen before are laid out as one ragged array.  In each
round every row merges all occurrences of its pair of lowest rank, all rows at the same time; the
symbols that are left are counted.  Every token of the vocabulary is made by one merge only, so a
new pair never has a lower rank than the pair just merged and the rounds give what merging one
pair after the other gives.
"""

from __future__ import annotations

import heapq
import json
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import regex
from pyspark.sql import DataFrame

from .common import CHUNK_BYTES, ship

OVER_LIMIT = 2048
#: Pre-tokens whose counts a Python worker keeps between steps; beyond it they are counted anew.
CACHE_WORDS = 1 << 18
#: Longer pre-tokens are never kept.
CACHE_CHARS = 64
#: Pre-tokens of more bytes are merged each by itself.
LONG_BYTES = 512
_NONE = np.int64(1 << 40)


def _late_characters() -> list[str]:
    """Letters and digits for the regex module that Python's own Unicode tables don't have yet."""
    every = "".join(map(chr, range(0x80, 0xD800))) + "".join(map(chr, range(0xE000, 0x110000)))
    return [c for c in regex.findall(r"[\p{L}\p{N}]", every) if unicodedata.category(c) == "Cn"]


def _ranges(chars: list[str]) -> str:
    """Characters, ascending, as ranges of a character class."""
    at = np.array([ord(c) for c in chars])
    cuts = np.flatnonzero(np.diff(at) != 1)
    return "".join(f"{chr(a)}-{chr(b)}" for a, b in zip(at[np.append(0, cuts + 1)], at[np.append(cuts, len(at) - 1)]))


class Merger:
    """Counts tokens as the given tokenizer file does."""

    def __init__(self, spec: dict):
        model = spec["model"]
        suffix = model["end_of_word_suffix"]
        vocab = model["vocab"]
        if (spec["normalizer"]["type"] != "Sequence" or [n["type"] for n in spec["normalizer"]["normalizers"]] != ["NFC", "Replace", "Lowercase"]
                or model["byte_fallback"] or model["ignore_merges"] or not suffix):
            raise ValueError("not a word-end byte-pair vocabulary with lower-casing")
        pre = spec["pre_tokenizer"]["pretokenizers"]
        pattern = pre[0]["pattern"]["Regex"]
        self.words = regex.compile(pattern)
        # the regex module may know letters and digits of a later Unicode version than the library:
        # for the rare texts with characters that Python's own tables lack, these are looked up
        self.pattern, self.spec, self._words_late = pattern, spec, None
        late = _late_characters() or ["\U0010ffff"]
        self.upper = regex.compile(f"[{late[0]}-\U0010ffff]")  # a quick look before the exact one
        self.late = regex.compile(f"[{_ranges(late)}]")
        self.special = [t["content"] for t in spec["added_tokens"] if t["special"]]
        self.cut = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        char_of = self._byte_chars()
        self.inner = np.array([vocab[c] for c in char_of], np.int64)
        self.last = np.array([vocab[c + suffix] for c in char_of], np.int64)
        pairs = [(vocab[a], vocab[b], vocab[a + b]) for a, b in model["merges"]]
        key = np.array([(a << 20) | b for a, b, _ in pairs], np.int64)
        if len({m for _, _, m in pairs}) != len(pairs):
            raise ValueError("a token is made by more than one merge")
        order = np.argsort(key)
        self.key, self.rank, self.made = key[order], order.astype(np.int64), np.array([m for _, _, m in pairs], np.int64)
        self.known: dict[str, int] = {}
        self.pairs: dict[int, tuple[int, int]] | None = None

    def words_late(self) -> regex.Pattern:
        """The pattern without the letters and digits that the library doesn't know as such."""
        if self._words_late is None:
            from tokenizers import Tokenizer

            cut = Tokenizer.from_str(json.dumps(self.spec)).pre_tokenizer.pre_tokenize_str
            drop = {kind: [c for c in _late_characters() if regex.match(kind, c) and (len(cut("a" + c)), len(cut("!" + c))) == (2, 1)]
                    for kind in (r"\p{L}", r"\p{N}")}
            pattern = self.pattern
            for kind, chars in drop.items():
                pattern = pattern.replace(kind, f"[{kind}--[{_ranges(chars)}]]") if chars else pattern
            self._words_late = regex.compile("(?V1)" + pattern)
        return self._words_late

    @staticmethod
    def _byte_chars() -> list[str]:
        """The printable character that stands for each byte in byte-level vocabularies: the
        printable Latin-1 characters stand for themselves, the others follow from U+0100 on."""
        own = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b]
        rest = iter(range(256, 512))
        return [chr(b) if b in own else chr(next(rest)) for b in range(256)]

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        want = (left << 20) | right
        at = np.minimum(np.searchsorted(self.key, want), len(self.key) - 1)
        return np.where(self.key[at] == want, self.rank[at], _NONE)

    def _count_long(self, raw: bytes) -> int:
        """Tokens of one long pre-token, by the same rounds: the occurrences of each pair are held by rank, and
        a round touches those of the lowest rank and their neighbours only."""
        if self.pairs is None:
            self.pairs = dict(zip(self.key.tolist(), zip(self.rank.tolist(), self.made[self.rank].tolist())))
        row = self.inner[np.frombuffer(raw, np.uint8)]
        row[-1] = self.last[raw[-1]]
        rank = self._ranks(row[:-1], row[1:])
        at = np.flatnonzero(rank != _NONE)
        at = at[np.argsort(rank[at], kind="stable")]
        cut = np.flatnonzero(np.diff(rank[at])) + 1
        places = {int(rank[g[0]]): g.tolist() for g in np.split(at, cut) if len(g)}
        sym, n, none = row.tolist(), len(row), (_NONE, -1)
        after, before, left = list(range(1, n + 1)), list(range(-1, n - 1)), n
        queue = sorted(places)
        while queue:
            lowest = heapq.heappop(queue)
            for i in sorted(places.pop(lowest)):
                j = after[i]
                if sym[i] < 0 or j >= n or self.pairs.get((sym[i] << 20) | sym[j], none)[0] != lowest:
                    continue  # merged meanwhile, as the second of aaa
                k = after[j]
                sym[i], sym[j], after[i] = self.pairs[(sym[i] << 20) | sym[j]][1], -1, k
                left -= 1
                if k < n:
                    before[k] = i
                for a, b in ((before[i], i), (i, k)):
                    if a >= 0 and b < n:
                        r = self.pairs.get((sym[a] << 20) | sym[b], none)[0]
                        if r != _NONE:
                            if r not in places:
                                places[r] = []
                                heapq.heappush(queue, r)
                            places[r].append(a)
        return left

    def count_words(self, words: list[str]) -> np.ndarray:
        """Tokens of each pre-token: short ones together as one ragged array, those above ``LONG_BYTES`` each
        by itself in time in proportion to its length."""
        raw = [w.encode() for w in words]
        long = [i for i, r in enumerate(raw) if len(r) > LONG_BYTES]
        if long:
            total = np.zeros(len(raw), np.int64)
            total[long] = [self._count_long(raw[i]) for i in long]
            short = [i for i, r in enumerate(raw) if len(r) <= LONG_BYTES]
            if short:
                total[short] = self.count_words([words[i] for i in short])
            return total
        size = np.array([len(r) for r in raw], np.int64)
        total = np.zeros(len(words), np.int64)
        row = np.arange(len(words))  # the rows still being merged
        sym = self.inner[np.frombuffer(b"".join(raw), np.uint8)]
        ends = np.cumsum(size) - 1
        sym[ends] = self.last[np.frombuffer(b"".join(r[-1:] for r in raw), np.uint8)]
        while len(row):
            first = np.concatenate(([0], np.cumsum(size)[:-1]))
            rank = np.full(len(sym), _NONE)
            rank[:-1] = self._ranks(sym[:-1], sym[1:])
            rank[first + size - 1] = _NONE  # no pair across rows
            least = np.minimum.reduceat(rank, first)
            done = least == _NONE
            if done.any():
                total[row[done]] = size[done]
                keep = np.repeat(~done, size)
                sym, rank, row, size, least = sym[keep], rank[keep], row[~done], size[~done], least[~done]
                if not len(row):
                    break
            hit = np.flatnonzero(rank == np.repeat(least, size))
            # of occurrences that overlap (aaa) the first, third, ... of a run of neighbours merge
            run = np.concatenate(([True], np.diff(hit) != 1))
            start = np.flatnonzero(run)
            hit = hit[(np.arange(len(hit)) - np.repeat(start, np.diff(np.append(start, len(hit))))) % 2 == 0]
            sym[hit] = self.made[rank[hit]]
            gone = np.zeros(len(sym), bool)
            gone[hit + 1] = True
            size = size - np.add.reduceat(gone, np.concatenate(([0], np.cumsum(size)[:-1]))).astype(np.int64)
            sym = sym[~gone]
        return total

    def pre_tokens(self, text: str) -> tuple[list[str], int]:
        """(pre-tokens, number of special strings) of a text."""
        parts, n_special = [text], 0
        if self.cut and any(s in text for s in self.special):
            parts = self.cut.split(text)
            n_special = len(parts) - 1
        out: list[str] = []
        for part in parts:
            part = unicodedata.normalize("NFC", part)
            # lower-casing is by character: a capital sigma has one small form wherever it stands;
            # white space need not be joined, since no pre-token has any
            words = self.words_late() if self.upper.search(part) and self.late.search(part) else self.words
            out += words.findall(part.replace("Σ", "σ").lower())
        return out, n_special

    def count_texts(self, texts: list[str]) -> list[int]:
        split = [self.pre_tokens(t) for t in texts]
        known, seen = self.known, set()
        for words, _ in split:
            seen.update(words)
        new = list(seen - known.keys())
        if new:
            if len(known) + len(new) > CACHE_WORDS:
                known.clear()
                new = list(seen)
            known.update(zip(new, self.count_words(new).tolist()))
        counts = [sum(map(known.__getitem__, words)) + n for words, n in split]
        if len(known) > CACHE_WORDS:
            known.clear()
        for w in new:
            if len(w) > CACHE_CHARS:
                known.pop(w, None)
        return counts


def load_merger(path: str) -> Merger:
    with open(path, encoding="utf-8") as f:
        return Merger(json.load(f))


def token_counts(docs: DataFrame, vocabulary: str | None = None, over: int = OVER_LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row of ``docs`` (doc_id, text, ...).

    ``vocabulary`` is the path of the tokenizer file on every executor (None: the installed public
    file ``word_bpe_49k.json``).  Whole texts are counted, without begin, end or other added special
    tokens; special strings inside a text count one token each.  An unbroken run of letters of any length
    (base64, unspaced scripts) is one pre-token and takes time in proportion to its length.  A null or empty text has 0 bytes
    and 0 tokens; a null doc_id stays null; repeated rows give a row each; columns other than
    doc_id and text are not read; an empty table gives an empty result."""
    ship(docs.sparkSession)

    def count(batches):
        path = vocabulary
        if path is None:
            import public_tokenizers
            path = public_tokenizers.path("word_bpe_49k.json")
        merger = load_merger(path)
        for batch in batches:
            texts = batch.column("text")
            n_bytes = pa.compute.fill_null(pa.compute.binary_length(texts), 0).cast(pa.int64())
            ends = np.cumsum(n_bytes.to_numpy())
            counts, a = [], 0
            while a < len(texts):
                b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + CHUNK_BYTES, side="right")))
                counts += merger.count_texts([t or "" for t in texts.slice(a, b - a).to_pylist()])
                a = b
            n = pa.array(counts, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), n_bytes, n, pa.compute.greater(n, over)],
                                             ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return (docs.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "CAST(text AS STRING) AS text")
            .mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean"))
