"""Column expressions that turn survey answers into numbers (no UDFs).

Every function maps a ``Column`` to a ``Column``; a whole cleaning pass is one
projection that stays inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .. import config as C


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def normalise_string(c) -> Column:
    """strip (Unicode whitespace) -> lower -> U+2019 and '?' to "'" -> drop U+200E.

    Strip runs before U+200E removal, so a space in front of the mark stays.
    """
    st = F.regexp_replace(F.regexp_replace(_c(c), r"(?U)^\s+", ""), r"(?U)\s+$", "")
    return F.translate(F.lower(st), "’?‎", "''")


def encode_product(c) -> Column:
    """'used to have' -> 1, 'have now' -> 2, 'never had' -> 0 (tested in this order)."""
    n = normalise_string(c)
    return (F.when(n.contains("used to have"), 1.0)
            .when(n.contains("have now"), 2.0)
            .when(n.contains("never had"), 0.0))


def encode_binary(c) -> Column:
    n = normalise_string(c)
    return F.when(n == "yes", 1.0).when(n == "no", 0.0)


def encode_ternary(c) -> Column:
    n = normalise_string(c)
    return F.when(n.isin("yes", "1"), 1.0).when(n.isin("no", "0"), 0.0)


def encode_records(c) -> Column:
    n = normalise_string(c)
    return (F.when(n.contains("always"), 3.0).when(n.contains("sometimes"), 2.0)
            .when(n == "yes", 1.0).when(n == "no", 0.0))


def encode_offers_credit(c) -> Column:
    n = normalise_string(c)
    return F.when(n.contains("always"), 2.0).when(n.contains("sometimes"), 1.0).when(n == "no", 0.0)


def encode_sex(c) -> Column:
    n = normalise_string(c)
    return F.when(n == "male", 1.0).when(n == "female", 0.0)


def encode_country(c) -> Column:
    """Lower only (no strip); unknown -> NULL.  Zimbabwe and Malawi share 1."""
    low = F.lower(_c(c))
    out = None
    for name, code in C.COUNTRY_MAP.items():
        out = (F.when(low == name, float(code)) if out is None else out.when(low == name, float(code)))
    return out


def encode_target(c) -> Column:
    """Exact, case-sensitive Low/Medium/High -> 0/1/2."""
    c = _c(c)
    out = None
    for name, code in C.TARGET_MAP.items():
        out = F.when(c == name, F.lit(code).cast("bigint")) if out is None else out.when(c == name, code)
    return out


def decode_target(c) -> Column:
    """0/1/2 -> Low/Medium/High via a literal map."""
    pairs = []
    for code, name in enumerate(C.TARGET_LABELS):
        pairs += [F.lit(code).cast("bigint"), F.lit(name)]
    return F.try_element_at(F.create_map(*pairs), _c(c).cast("bigint"))


# decimal number as pandas' to_numeric reads it (Spark also takes 12d, 0x1p3)
_NUMBER_RE = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"


def coerce_numeric(c, dtype=None) -> Column:
    """Parse to DOUBLE; unparseable, NaN and empty become NULL.

    For a column that is already numeric only NaN needs mapping to NULL.
    """
    c = _c(c)
    if dtype is not None and dtype != "string":
        d = c.cast("double")
        return F.when(~F.isnan(d), d)
    s = c.cast("string")
    parsed = F.when(s.rlike(_NUMBER_RE), F.trim(s).try_cast("double"))
    low = F.lower(F.trim(s))
    inf = (F.when(low.isin("inf", "+inf", "infinity", "+infinity"), F.lit(float("inf")))
           .when(low.isin("-inf", "-infinity"), F.lit(float("-inf"))))
    return F.coalesce(parsed, inf)
