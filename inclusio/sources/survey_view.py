"""Deterministic survey view over the driver's ``customer`` / ``orders`` tables.

The raw survey files are not shipped, so every survey-shaped operator runs on
a view derived from ``customer`` (one row per business) and ``orders``
(turnover).  The view is written once as portable SQL expressions; Spark
evaluates them with ``selectExpr`` over a DataFrame plan, DuckDB evaluates the
same text as the oracle.  Work grows with ``customer`` and ``orders``.

Answer column number i (0..29, order below) takes its value from
``list[((3k^2 + (2i+5)k + (7i+1)) % prime_i) % len(list)]``; the hash is
evaluated on ``k % prime_i`` so that it cannot overflow at any key size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import config as C

# --- fixed values: answer lists of the survey view (None = missing) --------
PRODUCT_ANSWERS = [
    "Have now", "Have now", " HAVE NOW ",
    "Used to have but don’t have now", "Used to have but don?t have now",
    "Never had", "Never had", "Never had", "Never had", "Don't know", None,
]
BINARY_ANSWERS = ["Yes", "YES ", "yes", "No", "NO", "no", "Don't know", None]
TERNARY_ANSWERS = [
    "Yes", "yes", "1", "No", "0", "No", "Don't know or N/A", "Refused",
    "Do not know / N‎/A", None,
]
RECORDS_ANSWERS = ["Yes, always", "Yes, sometimes", "Yes", "No", "No", "Don't know", None]
CREDIT_ANSWERS = ["Yes, always", "Yes, sometimes", "No", "No", None]
SEX_ANSWERS = ["Male", "FEMALE", "female", None]
# --- fixed values: one prime per answer column ------------------------------
PRIMES = [101, 103, 107, 109, 113, 127, 131, 137, 139, 149, 151, 157, 163, 167, 173,
          179, 181, 191, 193, 197, 199, 211, 223, 227, 229, 233, 239, 241, 251, 257]

ANSWER_COLUMNS = (
    [(c, PRODUCT_ANSWERS) for c in C.PRODUCT_COLS]
    + [(c, BINARY_ANSWERS) for c in C.BINARY_COLS]
    + [(c, TERNARY_ANSWERS) for c in C.TERNARY_COLS]
    + [("keeps_financial_records", RECORDS_ANSWERS),
       ("offers_credit_to_customers", CREDIT_ANSWERS),
       ("owner_sex", SEX_ANSWERS)]
)

RAW_COLUMNS = ["country"] + C.NUMERIC_COLS + [c for c, _ in ANSWER_COLUMNS]


def _sql_str(v):
    return "NULL" if v is None else "'" + v.replace("'", "''") + "'"


def _hash(i: int) -> str:
    """(3k^2 + (2i+5)k + (7i+1)) mod p_i, computed on k mod p_i: the same value for
    every non-negative key, and no 64-bit overflow however large the key grows."""
    p = PRIMES[i]
    r = f"(k % {p})"
    return f"((3*{r}*{r} + {2 * i + 5}*{r} + {7 * i + 1}) % {p})"


def _answer_expr(i: int, name: str, answers) -> str:
    whens = " ".join(f"WHEN {j} THEN {_sql_str(v)}" for j, v in enumerate(answers))
    return f"CASE {_hash(i)} % {len(answers)} {whens} END AS {name}"


def _score_expr() -> str:
    # score behind the label: credit card (column 2) and insurance (column 11)
    # push it up, the rest comes from the key and the account balance
    return (f"(CASE WHEN {_hash(2)} % 11 <= 2 THEN 25 ELSE 0 END) + "
            f"(CASE WHEN {_hash(11)} % 8 <= 2 THEN 25 ELSE 0 END) + "
            "(k * 31) % 50 + CAST(FLOOR(a / 500) AS BIGINT) AS ts")


BASE_EXPRS = [
    "k",
    "'ID_' || CAST(k AS STRING) AS ID",
    "CASE WHEN k % 5 = 0 THEN 'test' ELSE 'train' END AS split",
    "CASE WHEN n = 24 THEN NULL WHEN n % 4 = 0 THEN 'Eswatini' WHEN n % 4 = 1 THEN 'lesotho' "
    "WHEN n % 4 = 2 THEN 'MALAWI' ELSE 'Zimbabwe' END AS country",
    "CASE WHEN k % 23 = 0 THEN NULL ELSE CAST((k * 7) % 125 AS DOUBLE) END AS owner_age",
    "CASE WHEN k % 17 = 0 THEN NULL ELSE a END AS personal_income",
    "CASE WHEN k % 3 = 0 THEN NULL ELSE CASE WHEN k % 31 = 1 THEN CAST(-1 AS DOUBLE) "
    "ELSE CAST((k * 37) % 5000 AS DOUBLE) END END AS business_expenses",
    "CASE WHEN k % 13 = 0 THEN NULL ELSE CAST(tp AS DOUBLE) END AS business_turnover",
    "CASE WHEN k % 29 = 0 THEN NULL ELSE CAST((k * 11) % 40 AS DOUBLE) END AS business_age_years",
    "CASE WHEN k % 4 = 0 THEN NULL ELSE CAST((k * 5) % 12 AS DOUBLE) END AS business_age_months",
]

SURVEY_EXPRS = BASE_EXPRS + [_answer_expr(i, n, a) for i, (n, a) in enumerate(ANSWER_COLUMNS)] + [_score_expr()]
LABEL_EXPR = "CASE WHEN ts >= 85 THEN 'High' WHEN ts >= 55 THEN 'Medium' ELSE 'Low' END"

# columns the operators see (k, the score and the true label stay hidden)
SURVEY_COLUMNS = ["ID", "split"] + RAW_COLUMNS + [C.TARGET_COL]


def fixture_sql() -> str:
    """The portable view text: ``WITH o, b, s SELECT *, Target_all``."""
    return (
        "WITH o AS (SELECT o_custkey, SUM(CAST(FLOOR(o_totalprice) AS BIGINT)) AS tp FROM orders GROUP BY o_custkey),\n"
        "b AS (SELECT c_custkey AS k, c_nationkey AS n, c_acctbal AS a, tp FROM customer LEFT JOIN o ON o_custkey = c_custkey),\n"
        "s AS (SELECT " + ",\n".join(SURVEY_EXPRS) + " FROM b)\n"
        f"SELECT *, {LABEL_EXPR} AS Target_all FROM s"
    )


def survey_cte() -> str:
    """CTE prefix for oracle SQL: defines ``survey_all`` (with k) and ``survey``."""
    cols = ", ".join(c for c in SURVEY_COLUMNS if c != C.TARGET_COL)
    return (
        "WITH o AS (SELECT o_custkey, SUM(CAST(FLOOR(o_totalprice) AS BIGINT)) AS tp FROM orders GROUP BY o_custkey),\n"
        "b AS (SELECT c_custkey AS k, c_nationkey AS n, c_acctbal AS a, tp FROM customer LEFT JOIN o ON o_custkey = c_custkey),\n"
        "s AS (SELECT " + ",\n".join(SURVEY_EXPRS) + " FROM b),\n"
        f"survey_all AS (SELECT *, {LABEL_EXPR} AS Target_all FROM s),\n"
        f"survey AS (SELECT {cols}, CASE WHEN split = 'train' THEN Target_all END AS Target FROM survey_all)"
    )


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def survey_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The full view including ``k``, ``ts`` and ``Target_all``.

    Plan: partial aggregate of ``orders`` by customer (map-side combine), one
    shuffle on the customer key, left join with ``customer`` (both sides
    hash-partitioned on the key, or broadcast when AQE measures a small side),
    then one projection of CASE expressions inside whole-stage codegen.
    """
    orders = read_table(spark, sf_dir, "orders").select("o_custkey", "o_totalprice")
    tp = orders.groupBy("o_custkey").agg(
        F.sum(F.floor("o_totalprice").cast("bigint")).alias("tp"))
    cust = read_table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("n"), F.col("c_acctbal").alias("a"))
    b = cust.join(tp, cust.k == tp.o_custkey, "left").select("k", "n", "a", "tp")
    s = b.selectExpr(*SURVEY_EXPRS)
    return s.withColumn("Target_all", F.expr(LABEL_EXPR))


def survey(spark: SparkSession, sf_dir: str, keep_key: bool = False) -> DataFrame:
    """Raw survey rows (strings as answered); ``Target`` only on train rows."""
    s = survey_all(spark, sf_dir).withColumn(
        C.TARGET_COL, F.when(F.col("split") == "train", F.col("Target_all")))
    cols = (["k"] if keep_key else []) + SURVEY_COLUMNS
    return s.select(*cols)


def survey_split(spark: SparkSession, sf_dir: str, split: str) -> DataFrame:
    """Train or test part as separate inputs, as the reference reads two files.

    The test part has no ``Target`` column at all.
    """
    s = survey(spark, sf_dir).filter(F.col("split") == split).drop("split")
    return s if split == "train" else s.drop(C.TARGET_COL)
