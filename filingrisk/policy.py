"""Data policy: dates, code tables, alias lists and word lists.

Everything here is a fixed value of the data or of the output contract, stated
as plain text. Operators take them as parameters with these defaults.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import date

# --- Fixed values: event filings -------------------------------------------
REGIME_SWITCH = date(2004, 8, 23)
MIN_FYEAR = 2009

# concept -> (item code since the switch, item code before it)
ITEM_CODES: dict[str, tuple[str, str | None]] = {
    "bankruptcy": ("1.03", "3"),
    "auditor_change": ("4.01", "4"),
    "officer_departure": ("5.02", "6"),
    "covenant_accel": ("2.04", None),
    "impairment": ("2.06", None),
    "delisting": ("3.01", None),
    "restatement": ("4.02", None),
}
# A bankruptcy is the target, so it never becomes a feature.
FEATURE_CONCEPTS = (
    "auditor_change",
    "officer_departure",
    "covenant_accel",
    "impairment",
    "delisting",
)
EVENT_FORMS = ("8-K", "8-K/A")

# --- Fixed values: financial facts -------------------------------------------
ANNUAL_FORMS = ("10-K", "10-K/A")
# concept -> tags, best first
CONCEPT_TAGS: dict[str, tuple[str, ...]] = {
    "total_assets": ("Assets",),
    "total_liabilities": ("Liabilities",),
    "current_assets": ("AssetsCurrent",),
    "current_liabilities": ("LiabilitiesCurrent",),
    "cash": (
        "CashAndCashEquivalentsAtCarryingValue",
        "CashCashEquivalentsRestrictedCashAndRestrictedCashEquivalents",
    ),
    "long_term_debt": ("LongTermDebtNoncurrent", "LongTermDebt"),
    "equity": (
        "StockholdersEquity",
        "StockholdersEquityIncludingPortionAttributableToNoncontrollingInterest",
    ),
    "net_income": ("NetIncomeLoss", "ProfitLoss"),
    "revenue": (
        "Revenues",
        "RevenueFromContractWithCustomerExcludingAssessedTax",
        "SalesRevenueNet",
    ),
    "ebit": ("OperatingIncomeLoss",),
    "interest_expense": ("InterestExpense",),
    "retained_earnings": ("RetainedEarningsAccumulatedDeficit",),
    "inventory": ("InventoryNet",),
    "receivables": ("AccountsReceivableNetCurrent", "ReceivablesNetCurrent"),
}
CONCEPTS = tuple(CONCEPT_TAGS)

# concept -> accepted column names, best first
CONCEPT_ALIASES: dict[str, tuple[str, ...]] = {
    "total_assets": ("total_assets", "at", "assets"),
    "total_liabilities": ("total_liabilities", "lt", "liabilities"),
    "current_assets": ("current_assets", "act"),
    "current_liabilities": ("current_liabilities", "lct"),
    "cash": ("cash", "che", "cash_and_equivalents"),
    "long_term_debt": ("long_term_debt", "dltt"),
    "debt_in_current": ("debt_in_current", "dlc"),
    "equity": ("equity", "ceq", "seq", "stockholders_equity", "total_equity"),
    "net_income": ("net_income", "ni", "ib"),
    "revenue": ("revenue", "sale", "sales", "revt"),
    "ebit": ("ebit", "oiadp", "operating_income"),
    "interest_expense": ("interest_expense", "xint"),
    "retained_earnings": ("retained_earnings", "re"),
    "inventory": ("inventory", "invt"),
    "receivables": ("receivables", "rect"),
}
TREND_RATIOS = (
    "fin_leverage",
    "fin_roa",
    "fin_debt_to_equity",
    "fin_current_ratio",
    "fin_log_assets",
    "fin_asset_turnover",
    "fin_net_margin",
)
INDUSTRY_RATIOS = ("fin_leverage", "fin_roa", "fin_current_ratio", "fin_wc_to_assets")
INDUSTRY_MIN_PEERS = 5

# --- Fixed values: column roles ------------------------------------------------
LABEL_COLUMNS = ("label", "misstate", "fraud", "is_fraud", "target", "y", "default")
ID_COLUMNS = ("doc_id", "accession", "accession_number")
TEXT_COLUMNS = ("mda", "text", "item7", "item_7", "mgmt_discussion", "risk_factors")
YEAR_COLUMNS = ("fyear", "fiscal_year", "year")
TEXT_ALIASES = ("text", "mda_text", "md_a", "content")

# --- Fixed values: text profile ------------------------------------------------
HEDGE_WORDS = tuple(dict.fromkeys("""
    may might could would should possibly potentially approximately
    believe believes believed anticipate anticipates expect expects
    estimate estimates estimated assume assumes assumption assumptions
    uncertain uncertainty uncertainties likely unlikely appears appear
    seems generally substantially significantly subject contingent
    approximately roughly certain various
""".split()))
NEGATIVE_TERMS = tuple("""
    impairment impairments default defaults litigation lawsuit lawsuits
    restatement restatements deficiency deficiencies weakness weaknesses
    covenant covenants breach breaches decline declines declined loss losses
    writedown writedowns write-off write-offs delinquency delinquencies
    downgrade downgraded insolvency bankruptcy fraud investigation
    investigations subpoena penalty penalties fines adverse adversely
    volatility restructuring layoffs going-concern concern doubt
""".split())
POSITIVE_TERMS = tuple("""
    growth grow strong stronger record improved improvement improvements
    profitable profitability exceeded robust momentum favorable favorably
    innovation expanding expansion successful success confident
""".split())
PROFILE_SCORES = (
    "vagueness_score",
    "redundancy_score",
    "complexity_score",
    "risk_sentiment",
    "confidence",
)
PROFILE_PREFIX = "llm_"
SUMMARY_CHARS = 600
INDICATORS_KEPT = 8
INDICATOR_CHARS = 80
HEURISTIC_CONFIDENCE = 0.35
SUMMARY_FORMAT = "[MOCK] %d Tokens, %d Sätze; Hedge-Dichte %s/100; dominierende Risikobegriffe: %s."
SUMMARY_NO_TERMS = "keine"
FALLBACK_FORMAT = "[fallback] %s"
FALLBACK_SHORT = "text too short for analysis"
# The filing text policy of the frozen benchmark; operators default to whole texts.
FILING_TEXT_CHARS = 40_000
PROMPT_TEXT_CHARS = 12_000
MIN_TEXT_CHARS = 200

# --- Fixed values: score presentation ---------------------------------------------
BASE_RATE_12M = 0.012
BAND_MID_MULT = 0.85
BAND_HIGH_MULT = 2.5
FRAUD_BAND_HIGH = 0.22
FRAUD_BAND_MID = 0.15
# label source -> (high, mid, low) band names
BAND_NAMES = {
    "default": ("über Basisrate", "um Basisrate", "unter Basisrate"),
    "fraud": ("erhöht", "mittel", "niedrig"),
}
HORIZON_GRID = (12, 24, 36, 60, 120)
WIDE_HORIZONS = (12, 24, 60, 120)
WEIGHT_FINANCIAL = 0.6
WEIGHT_TEXT = 0.4


@dataclass(frozen=True)
class SamplePolicy:
    """How a modelling sample is labelled and filtered; stored with each model.

    By default no row is left out; FROZEN_POLICY has the cuts of the frozen samples.
    """

    label_source: str = "default"
    horizon_months: int = 12
    trust_legacy_regime: bool = False
    regime_switch: date = REGIME_SWITCH
    min_fyear: int | None = None
    require_financials: bool = False
    window_days: int = 365
    test_size: float = 0.2
    seed: int = 42
    item_codes: dict[str, tuple[str, str | None]] = field(default_factory=lambda: dict(ITEM_CODES))


#: The sample of the frozen and rolling evaluations.
FROZEN_POLICY = SamplePolicy(min_fyear=MIN_FYEAR, require_financials=True)
