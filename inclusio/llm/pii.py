"""Personal data by weak-supervision aggregation (native).

1. Base spans (e-mail, IP, card, phone) come from strict patterns; further candidates from wider ones
   (written-out addresses, numbers without country code, numbers that fail a check).
2. Labelers vote on every candidate, for (1), against (-1) or not at all (0): the strict pattern, the
   usual shape, a gazetteer (top-level domains, calling codes, card prefixes, reserved networks), the
   words before it, and the characters beside it.
3. Expectation-maximisation over the counts of vote patterns estimates how reliable each labeler is for
   true and false candidates of each kind, and so the chance that a pattern is personal data.
4. A logistic span classifier is trained on these chances; candidates that it accepts are added to the
   base spans, which always stay.

Texts are read once, by array expressions; the vote patterns that reach the driver are at most
``4 * 3**5 * 4`` rows, whatever the corpus.  Patterns with ``\\G`` and possessive quantifiers take
linear time and constant stack on texts that are one long run.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from .common import staged, text_or_empty

KINDS = ("email", "ip", "card", "phone")
#: Strict patterns, in forms that never back off (equal to the plain ones, match by match).
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must have for a pattern to match at all.
NEEDS = {"email": "contains(body, '@')", "ip": r"body RLIKE '[0-9]\\.[0-9]'", "card": r"body RLIKE '[0-9](?:[\\x20-]?[0-9]){11}'", "phone": "contains(body, '+')"}
#: Wider patterns of further candidates.
WIDE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]{1,64}+[\x20]?+(?:\[at\]|\(at\)|@)[\x20]?+[A-Za-z0-9-]{1,63}+(?:[\x20]?+(?:\[dot\]|\(dot\)|\.)[\x20]?+[A-Za-z0-9-]{2,63}+)++",
    "phone": r"(?<![0-9+])(?:00[1-9][0-9]{0,2}[\x20.-])?(?:\([0-9]{3}\)[\x20]?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9])",
}
WIDE_NEEDS = {"email": "(contains(body, '@') OR contains(body, '[at]') OR contains(body, '(at)'))",
              "phone": r"body RLIKE '[0-9]{3}[\\x20.-][0-9]{4}'"}

# What the gazetteers know
TOP_LEVEL = "com net org edu gov mil int info biz io de fr es it uk us ca eu ch at nl be se no dk pl pt br mx ar jp cn in au nz ru".split()
CALLING_CODES = "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 54 55 56 57 60 61 62 63 64 65 66 81 82 84 86 90 91 351 352 353 358 420".split()
CARD_PREFIXES = "4 51 52 53 54 55 22 23 24 25 26 27 34 37 35 6011 62 64 65 36 38".split()
RESERVED_NETS = "0 10 127 224 225 226 227 228 229 230 231 232 233 234 235 236 237 238 239 240 255".split()
# Words that speak for and against each kind
CUES = {
    "email": ("e-?mail|mail|contact|contacto|kontakt|write|address|adresse", "regex|pattern|example"),
    "ip": ("ip|host|server|address|adresse|addr|login|from", "version|release|section|chapter|ver|v"),
    "card": ("card|credit|visa|mastercard|amex|karte|carte|tarjeta|payment|pay", "isbn|order|invoice|serial|tracking|id|key|ref"),
    "phone": ("tel|phone|call|fax|mobile|cell|telefon|telephone|t[ée]l[ée]phone|tel[ée]fono|whatsapp", "isbn|order|invoice|serial|version|id|ref"),
}
#: Characters before a candidate that the context labeler reads.
CONTEXT = 40
LABELERS = ("strict", "shape", "gazetteer", "context", "beside")
ROUNDS = 30
STRICT_START = 4


def _q(pattern: str) -> str:
    """A pattern as a SQL string."""
    return "r'" + pattern + "'"


def _matches(pattern: str, needs: str) -> str:
    """Array of (start, end, m, before, prev, after): all matches of ``body``, by the lengths of matches and
    of the pieces between them (code points, end exclusive), with the text before a match (``CONTEXT``
    characters, back to the last match at most) and the characters beside it.  Everything comes from
    these pieces, so the time doesn't grow with matches times length."""
    p = _q(pattern)
    return f"""CASE WHEN {needs} THEN flatten(transform(array(struct(regexp_extract_all(body, {p}, 0) AS ms, split(body, {p}, -1) AS segs)), x ->
      IF(size(x.ms) = 0, {_NONE}, flatten(transform(array(aggregate(sequence(0, size(x.ms) - 1), struct(0 AS pos, CAST(array() AS ARRAY<INT>) AS at), (acc, i) -> struct(
        acc.pos + length(x.segs[i]) + length(x.ms[i]) AS pos, array_append(acc.at, acc.pos + length(x.segs[i])) AS at), acc -> acc.at)), at ->
        transform(x.ms, (m, i) -> struct(at[i] AS start, at[i] + length(m) AS end, m AS m, right(x.segs[i], {CONTEXT}) AS before,
          CASE WHEN x.segs[i] != '' THEN right(x.segs[i], 1) WHEN i > 0 THEN right(x.ms[i - 1], 1) ELSE '' END AS prev,
          CASE WHEN x.segs[i + 1] != '' THEN left(x.segs[i + 1], 1) WHEN i + 1 < size(x.ms) THEN left(x.ms[i + 1], 1) ELSE '' END AS after)))))))
      ELSE {_NONE} END"""


_NONE = "CAST(array() AS ARRAY<STRUCT<start: INT, end: INT, m: STRING, before: STRING, prev: STRING, after: STRING>>)"


def _digits(m: str) -> str:
    return rf"regexp_replace({m}, r'[^0-9]', '')"


def _luhn(d: str) -> str:
    """Whether a string of digits passes the Luhn check."""
    return (f"aggregate(sequence(1, length({d})), 0, (s, i) -> s + CASE WHEN i % 2 = 1 THEN int(substring({d}, -i, 1)) "
            f"WHEN int(substring({d}, -i, 1)) > 4 THEN 2 * int(substring({d}, -i, 1)) - 9 ELSE 2 * int(substring({d}, -i, 1)) END) % 10 = 0")


def _passes(kind: str, c: str) -> str:
    """The strict test of a match."""
    m = f"{c}.m"
    return {
        "email": "true",
        "ip": rf"forall(split({m}, r'\.'), o -> length(ltrim('0', o)) <= 3 AND int(concat('0', right(ltrim('0', o), 3))) <= 255)",
        "card": f"(length({_digits(m)}) BETWEEN 13 AND 19 AND {_luhn(_digits(m))})",
        "phone": f"length({_digits(m)}) BETWEEN 9 AND 15",
    }[kind]


def _in(value: str, words: list[str]) -> str:
    return f"{value} IN ({', '.join(repr(w) for w in words)})"


def _votes(kind: str) -> list[str]:
    """SQL of each labeler's vote on a candidate c (start, end, m, before, prev, after, strict)."""
    m = "c.m"
    last = rf"lower(regexp_extract({m}, r'([A-Za-z0-9-]+)$', 1))"
    d = _digits(m)
    shape = {"email": rf"IF(length({m}) <= 254 AND {m} RLIKE r'^[A-Za-z0-9][A-Za-z0-9._%+-]*+.{{1,6}}[A-Za-z0-9-]+.*[A-Za-z]{{2,}}$', 1, -1)",
             "ip": rf"IF({m} RLIKE r'^(?:0|[1-9][0-9]{{0,2}})(?:\.(?:0|[1-9][0-9]{{0,2}})){{3}}$', 1, -1)",
             "card": rf"IF({m} RLIKE r'^(?:[0-9]{{13,19}}|[0-9]{{4}}([\x20-])[0-9]{{4}}\1[0-9]{{4}}\1[0-9]{{1,7}}|[0-9]{{4}}[\x20-][0-9]{{6}}[\x20-][0-9]{{5}})$', 1, -1)",
             "phone": rf"IF({m} RLIKE r'^(?:\+|00)?[0-9]{{0,3}}[\x20.-]?\(?[0-9]{{2,4}}\)?(?:[\x20.-]?[0-9]{{2,4}}){{2,4}}$', 1, -1)"}[kind]
    known = {"email": f"IF({_in(last, TOP_LEVEL)}, 1, -1)",
             "ip": rf"IF({_in(f'''regexp_extract({m}, r'^([0-9]+)', 1)''', RESERVED_NETS)}, -1, 1)",
             "card": f"IF(exists(array({', '.join(repr(p) for p in CARD_PREFIXES)}), p -> startswith({d}, p)), 1, -1)",
             "phone": f"IF(startswith({m}, '+') OR startswith({m}, '00'), IF(exists(array({', '.join(repr(p) for p in CALLING_CODES)}), p -> startswith(ltrim('0', {d}), p)), 1, -1), 0)"}[kind]
    before = "lower(c.before)"
    good, bad = CUES[kind]
    context = (rf"CASE WHEN {before} RLIKE r'(?:^|[^\p{{L}}])(?:{good})(?:[^\p{{L}}]|$)' THEN 1 "
               rf"WHEN {before} RLIKE r'(?:^|[^\p{{L}}])(?:{bad})(?:[^\p{{L}}]|$)' THEN -1 ELSE 0 END")
    beside = r"IF(c.prev RLIKE r'[\p{L}\p{N}]' OR c.after RLIKE r'[\p{L}\p{N}]', -1, 1)"
    return ["IF(c.strict, 1, -1)", shape, known, context, beside]


def candidates(docs: DataFrame) -> DataFrame:
    """(doc_id, base, extra) of every row: ``base`` holds the strict spans (kind, start, end, votes), in
    the order of kinds and starts; ``extra`` the further candidates, none of which overlaps a base one."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("body"))
    for k in KINDS:
        rows = rows.withColumn(f"raw_{k}", F.expr(_matches(BASE[k], NEEDS[k])))
        rows = rows.withColumn(f"base_{k}", F.expr(f"filter(raw_{k}, c -> {_passes(k, 'c')})"))
    # short-lived helper arrays: one row's matches
    rows = rows.withColumn("taken", F.expr(f"concat({', '.join(f'base_{k}' for k in KINDS)})"))
    more = {"email": f"({_matches(WIDE['email'], WIDE_NEEDS['email'])})", "phone": f"({_matches(WIDE['phone'], WIDE_NEEDS['phone'])})",
            "ip": "raw_ip", "card": f"filter(raw_card, c -> length({_digits('c.m')}) BETWEEN 12 AND 19)"}
    # what the strict test takes is base: left out before the overlaps are looked for
    more["email"] = rf"filter({more['email']}, c -> NOT c.m RLIKE r'^[^\x20\[\]()]+$')"
    more |= {k: f"filter({more[k]}, c -> NOT {_passes(k, 'c')})" for k in ("ip", "card")}
    for n, k in enumerate(KINDS):
        free = "NOT exists(taken, b -> b.start < c.end AND c.start < b.end)"
        rows = rows.withColumn(f"more_{k}", F.expr(f"filter({more[k]}, c -> {free})"))
        for name, strict in ((f"base_{k}", "true"), (f"more_{k}", "false")):
            votes = ", ".join(_votes(k))
            size = "CASE WHEN length(c.m) < 12 THEN 0 WHEN length(c.m) < 16 THEN 1 WHEN length(c.m) < 22 THEN 2 ELSE 3 END"
            rows = rows.withColumn(name, F.expr(
                f"transform(transform({name}, c -> struct(c.start, c.end, c.m, c.before, c.prev, c.after, {strict} AS strict)), c -> struct({n} AS kind, c.start, c.end, array({votes}) AS votes, {size} AS size))"))
    return rows.select("doc_id", F.expr(f"concat({', '.join(f'base_{k}' for k in KINDS)})").alias("base"),
                       F.expr(f"concat({', '.join(f'more_{k}' for k in KINDS)})").alias("extra"))


def reliabilities(patterns: list[tuple[int, tuple[int, ...], float]], rounds: int = ROUNDS):
    """Expectation-maximisation over (kind, votes, count): (chance of each pattern, reliabilities).

    Per kind: the share of true candidates, and for each labeler the chance of each vote on true and
    on false candidates, with one more case of each so that none is 0.  The start is the vote sum, in
    which the strict test, the labeler known best, counts ``STRICT_START`` times."""
    chance = [1 / (1 + math.exp(-float(sum(v) + (STRICT_START - 1) * v[0]))) for _, v, _ in patterns]
    model = {}
    for _ in range(rounds):
        for kind in {k for k, _, _ in patterns}:
            own = [(v, n, c) for (k, v, n), c in zip(patterns, chance) if k == kind]
            true, total = sum(n * c for _, n, c in own), sum(n for _, n, _ in own)
            votes = [{vote: ((sum(n * c for v, n, c in own if v[j] == vote) + 1) / (true + 3),
                             (sum(n * (1 - c) for v, n, c in own if v[j] == vote) + 1) / (total - true + 3)) for vote in (-1, 0, 1)}
                     for j in range(len(LABELERS))]
            model[kind] = ((true + 1) / (total + 2), votes)
        chance = []
        for kind, v, _ in patterns:
            share, votes = model[kind]
            odds = math.log(share / (1 - share)) + sum(math.log(votes[j][x][0] / votes[j][x][1]) for j, x in enumerate(v))
            chance.append(1 / (1 + math.exp(-max(-30.0, min(30.0, odds)))))
    return chance, model


def _inputs(kind: int, votes, size: int) -> list[int]:
    return [1, *(int(kind == k) for k in range(1, len(KINDS))), *votes, *(int(v == 0) for v in votes), *(int(size == s) for s in (1, 2, 3))]


def fit_classifier(cases: list[tuple[list[int], float, float]], steps: int = 400, rate: float = 0.5, decay: float = 1e-3) -> list[float]:
    """Logistic regression on (inputs, chance, count), by gradient descent with momentum."""
    if not cases:
        return []
    size, total = len(cases[0][0]), sum(math.sqrt(n) for _, _, n in cases)
    w, move = [0.0] * size, [0.0] * size
    for _ in range(steps):
        grad = [decay * x for x in w]
        for x, y, n in cases:
            z = sum(a * b for a, b in zip(w, x) if b)
            err = (1 / (1 + math.exp(-max(-30.0, min(30.0, z)))) - y) * math.sqrt(n) / total  # rare patterns count too
            for j, b in enumerate(x):
                if b:
                    grad[j] += err * b
        move = [0.9 * m - rate * g for m, g in zip(move, grad)]
        w = [a + m for a, m in zip(w, move)]
    return w


def _score(w: list[float]) -> Column:
    """The classifier as an expression on a candidate c."""
    names = ["1", *(f"int(c.kind = {k})" for k in range(1, len(KINDS))), *(f"c.votes[{j}]" for j in range(len(LABELERS))),
             *(f"int(c.votes[{j}] = 0)" for j in range(len(LABELERS))), *(f"int(c.size = {s})" for s in (1, 2, 3))]
    return " + ".join(f"({x!r}D * {name})" for x, name in zip(w, names))


def find_pii(docs: DataFrame) -> DataFrame:
    """doc_id, base, spans of every row of ``docs`` (doc_id, text, ...): arrays of (kind, start, end) in
    code points, end exclusive, by kind (email, ip, card, phone) and start.  ``base``: the strict spans;
    ``spans``: these and the candidates that the trained classifier accepts.

    Whole texts are read.  A null text counts as empty and has no spans; a null doc_id stays null;
    repeated rows give a row each; other columns are not read; an empty table gives an empty result."""
    found = staged(candidates(docs), "pii")
    rows = (found.select(F.explode(F.concat("base", "extra")).alias("c")).groupBy("c.kind", "c.votes", "c.size")
            .agg(F.count(F.lit(1)).alias("n")).collect())  # at most 4 * 3**5 * 4 patterns
    rows = sorted((r["kind"], tuple(r["votes"]), r["size"], r["n"]) for r in rows)
    merged: dict[tuple, float] = {}
    for kind, votes, _, n in rows:
        merged[kind, votes] = merged.get((kind, votes), 0) + n
    patterns = [(k, v, n) for (k, v), n in merged.items()]
    chance, _ = reliabilities(patterns)
    of = {(k, v): c for (k, v, _), c in zip(patterns, chance)}
    w = fit_classifier([(_inputs(k, v, s), of[k, v], n) for k, v, s, n in rows])
    accept = f"filter(extra, c -> {_score(w)} > 0)" if w else "extra"
    span = "c -> struct(c.kind AS kind, c.start AS start, c.end AS end)"
    return found.select("doc_id", F.expr(f"array_sort(transform(base, {span}))").alias("base"),
                        F.expr(f"array_sort(concat(transform(base, {span}), transform({accept}, {span})))").alias("spans"))


def span_string(spans: str) -> Column:
    """``kind:start:end``, comma-joined."""
    names = f"element_at(array({', '.join(repr(k) for k in KINDS)}), s.kind + 1)"
    return F.expr(f"array_join(transform({spans}, s -> concat({names}, ':', s.start, ':', s.end)), ',')")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, the number of base spans of each kind, base_sha256 and spans of every row."""
    found = find_pii(docs)
    return found.select("doc_id", *[F.expr(f"CAST(size(filter(base, s -> s.kind = {n})) AS BIGINT)").alias(f"n_{k}") for n, k in enumerate(KINDS)],
                        F.sha2(span_string("base"), 256).alias("base_sha256"), span_string("spans").alias("spans"))
