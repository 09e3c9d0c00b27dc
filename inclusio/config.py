"""Column groups, label domains, code maps and search grids.

Everything in this module is a fixed value: the names, maps and constants
must equal the survey's own so that results match.  Operators take column
lists as parameters; these are the defaults.
"""

from __future__ import annotations

# --- fixed values: identifiers ---------------------------------------------
ID_COL = "ID"
TARGET_COL = "Target"
N_CLASSES = 3

# --- fixed values: label domain (ordinal Low < Medium < High) ---------------
TARGET_LABELS = ["Low", "Medium", "High"]
TARGET_MAP = {"Low": 0, "Medium": 1, "High": 2}

# --- fixed values: country codes (two countries share code 1) --------------
COUNTRY_MAP = {"eswatini": 3, "zimbabwe": 1, "malawi": 1, "lesotho": 0}
COUNTRY_LESOTHO = 0
COUNTRY_ZIM_MALAWI = 1
COUNTRY_ESWATINI = 3

# --- fixed values: column groups of the raw survey --------------------------
PRODUCT_COLS = [
    "motor_vehicle_insurance",
    "has_mobile_money",
    "has_credit_card",
    "has_loan_account",
    "has_internet_banking",
    "has_debit_card",
    "medical_insurance",
    "funeral_insurance",
    "uses_friends_family_savings",
    "uses_informal_lender",
]
BINARY_COLS = [
    "has_cellphone",
    "has_insurance",
    "future_risk_theft_stock",
    "problem_sourcing_money",
    "marketing_word_of_mouth",
    "motivation_make_more_money",
    "covid_essential_service",
]
TERNARY_COLS = [
    "attitude_stable_business_environment",
    "attitude_worried_shutdown",
    "attitude_satisfied_with_achievement",
    "attitude_more_successful_next_year",
    "perception_insurance_doesnt_cover_losses",
    "perception_cannot_afford_insurance",
    "perception_insurance_companies_dont_insure_businesses_like_yours",
    "perception_insurance_important",
    "compliance_income_tax",
    "current_problem_cash_flow",
]
NUMERIC_COLS = [
    "owner_age",
    "personal_income",
    "business_expenses",
    "business_turnover",
    "business_age_years",
    "business_age_months",
]
SPECIAL_COLS = ["keeps_financial_records", "offers_credit_to_customers", "owner_sex"]

# --- fixed values: feature groups ------------------------------------------
FORMAL_ACCESS_COLS = [
    "has_credit_card",
    "has_loan_account",
    "has_internet_banking",
    "has_debit_card",
    "motor_vehicle_insurance",
    "medical_insurance",
]
INSURANCE_PRODUCT_COLS = ["motor_vehicle_insurance", "medical_insurance", "funeral_insurance"]
INFORMAL_COLS = ["uses_friends_family_savings", "uses_informal_lender"]
BANKING_COLS = ["has_credit_card", "has_internet_banking", "has_debit_card"]
ATTITUDE_COLS = [
    "attitude_stable_business_environment",
    "attitude_satisfied_with_achievement",
    "attitude_more_successful_next_year",
]
NEGATIVE_ATTITUDE_COLS = [
    "attitude_worried_shutdown",
    "perception_cannot_afford_insurance",
    "perception_insurance_doesnt_cover_losses",
]
MONEY_COLS = ["personal_income", "business_expenses", "business_turnover"]
# columns the notebook's access score looks at (the listed bank-account
# column does not exist in the data and is skipped)
ACCESS_SCORE_COLS = [
    "has_loan_account",
    "has_internet_banking",
    "has_debit_card",
    "medical_insurance",
    "funeral_insurance",
]

# --- fixed values: target-encoded columns, smoothing -----------------------
TARGET_ENCODE_COLS = [
    "country",
    "has_credit_card",
    "has_loan_account",
    "has_internet_banking",
    "has_debit_card",
    "motor_vehicle_insurance",
    "medical_insurance",
    "funeral_insurance",
    "has_mobile_money",
    "uses_friends_family_savings",
    "uses_informal_lender",
    "keeps_financial_records",
    "offers_credit_to_customers",
    "compliance_income_tax",
]
TE_SMOOTHING = 10.0

# --- fixed values: thresholds, folds, grids --------------------------------
MISSING_FLAG_RATE = 0.20
N_FOLDS = 5
SEED = 42
THRESH_LO = 0.05
THRESH_HI = 0.95
LESOTHO_HIGH_PIN = 0.95
OWNER_AGE_BINS = [0, 25, 35, 45, 55, 120]
RATIO_CAP = 100.0
BLEND_CAT_WEIGHT = 0.3

# pandas' default missing-value tokens for CSV reads
NA_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
]


def linspace(lo: float, hi: float, n: int) -> list[float]:
    """numpy.linspace as plain doubles: i*step + lo, last point exactly hi."""
    if n == 1:
        return [lo]
    step = (hi - lo) / (n - 1)
    out = [i * step + lo for i in range(n)]
    out[-1] = hi
    return out


def arange(lo: float, hi: float, step: float) -> list[float]:
    """numpy.arange for floats: lo + i*step while below hi."""
    import math
    n = int(math.ceil((hi - lo) / step))
    return [lo + i * step for i in range(n)]


def simplex_weights(step: float = 0.1) -> list[tuple[float, float, float]]:
    """Weight triples on a step grid whose sum is 1 within 1e-9, in loop order."""
    vals = arange(0.0, 1.0 + step, step)
    return [(a, b, c) for a in vals for b in vals for c in vals if abs(a + b + c - 1.0) < 1e-9]


def threshold_grid(n: int) -> list[float]:
    return linspace(THRESH_LO, THRESH_HI, n)


def feature_columns(columns, drop=(ID_COL, TARGET_COL)):
    """All columns except ID and Target, in order."""
    return [c for c in columns if c not in drop]
