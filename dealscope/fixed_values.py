"""Fixed values.

Word lists, thresholds and lookup tables that results depend on. They are stated
plainly here and nowhere else; every operator takes them as parameter defaults.
"""

# --- fixed values: semantic type inference -----------------------------------
CURRENCY_NAMES = (
    "revenue", "amount", "price", "value", "cost", "salary", "fee",
    "budget", "spend", "income", "profit", "margin", "arpu", "arr",
    "mrr", "ltv", "acv", "tcv", "deal_value", "contract_value",
    "invoice", "payment", "charge", "gross", "net",
)
PERCENTAGE_NAMES = (
    "pct", "percent", "rate", "ratio", "win_rate", "churn", "conversion",
    "growth", "margin_pct", "discount", "tax", "utilisation", "utilization",
    "completion", "coverage",
)
ID_SUFFIXES = ("_id", "_key", "_ref", "_code", "_no", "_number", "_uuid", "_guid")
ID_PREFIXES = ("id_", "ref_", "uuid_")
ID_EXACT = ("id", "key", "ref", "code", "uuid", "guid")
EMAIL_HINTS = ("email", "mail", "e_mail")
PHONE_HINTS = ("phone", "mobile", "tel", "fax", "cell")
PROFILE_ID_HINTS = ("_id", "_key", "_ref", "_code", "_no", "_uuid")
CURRENCY_SYMBOLS = "[£$€¥₹]"
CURRENCY_VALUE = r"^[£$€¥₹\s]?-?[\d,]+\.?\d*$"
PERCENTAGE_VALUE = r"^-?[\d,]+\.?\d*\s*%$"
DATE_PATTERNS = (
    "yyyy-M-d", "d/M/yyyy", "M/d/yyyy", "yyyy/M/d", "d-M-yyyy", "yyyy-M-d'T'H:m:s",
)
MIN_CURRENCY_MATCH = 0.40
MIN_PERCENTAGE_MATCH = 0.40
MIN_DATE_PARSE = 0.70
MIN_NUMERIC_PARSE = 0.90
MIN_ID_DISTINCT = 0.80
MAX_CATEGORIES = 50
MAX_CATEGORY_RATIO = 0.10
# CSV cells read as null
NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
)

# --- fixed values: joins ------------------------------------------------------
MIN_OVERLAP = 0.30
MIN_NAME_SIMILARITY = 0.35
NAME_WEIGHT = 0.40
OVERLAP_WEIGHT = 0.60
JOIN_CONFIDENCE = 0.6
MAX_LOSS_RATE = 0.20
MAX_EXPANSION = 1.10
KEY_SUFFIXES = ("_id", "_key", "_ref", "_code", "_no", "_num", "_number", "_uuid", "_guid", "_fk", "_pk")
KEY_PREFIXES = ("id_", "fk_", "pk_", "ref_")

# --- fixed values: quality rules ---------------------------------------------
NULL_WARN_PCT = 30.0
NULL_ERROR_PCT = 100.0
DUPLICATE_ERROR_PCT = 5.0
OVERALL_NULL_WARN_PCT = 30.0
SEVERITIES = ("error", "warning", "info")
AMBER_NULL_PCT = 10.0
RED_NULL_PCT = 30.0

# --- fixed values: dashboard and account health -------------------------------
WON_STAGES = ("won", "closed won", "win")
WIN_RATE_BENCHMARK = 28
SALES_CYCLE_BENCHMARK = 84
DORMANT_DAYS = 90
AT_RISK_DAYS = 60
HEALTHY_DAYS = 30
STALE_DAYS = 90

# --- fixed values: answer scoring ---------------------------------------------
SCORE_THRESHOLD = 85
MAX_ITERATIONS = 5
PATTERN_SCORE = 90
TRAINING_SCORE = 75
FINE_TUNE_SCORE = 80
QUESTION_SIMILARITY = 0.85
RETRY_PENALTY = 20
NULL_PENALTY = 30
SINGLE_ROW_PENALTY = 10
ASSUMPTION_PENALTY = 10
EMPTY_RESULT_CAP = 20
INTENT_KEYWORDS = (
    ("aggregation", ("total", "sum", "average", "count", "how many", "how much")),
    ("comparison", ("compare", "versus", "vs", "difference", "between")),
    ("ranking", ("top", "bottom", "best", "worst", "highest", "lowest", "ranked")),
    ("trend", ("over time", "trend", "month", "year", "quarterly", "growth")),
    ("pivot", ("breakdown", "cross", "matrix", "pivot")),
    ("recommendation", ("should", "recommend", "prioritise", "focus", "what to")),
    ("what_if", ("if we", "scenario", "what would", "hypothetical", "what if")),
    ("data_quality", ("missing", "null", "incomplete", "duplicate", "error")),
    ("benchmark", ("benchmark", "industry", "typical", "normal", "sector")),
)
RUBRIC_WEIGHTS = {
    "aggregation": {"code_correctness": 30, "result_completeness": 25, "interpretation_quality": 30, "chart_appropriateness": 15},
    "ranking": {"code_correctness": 30, "result_completeness": 25, "interpretation_quality": 30, "chart_appropriateness": 15},
    "trend": {"code_correctness": 30, "result_completeness": 25, "interpretation_quality": 30, "chart_appropriateness": 15},
    "pivot": {"code_correctness": 25, "result_completeness": 25, "interpretation_quality": 25, "excel_export_quality": 25},
    "what_if": {"scenario_logic": 35, "result_completeness": 25, "interpretation_quality": 25, "recommendation_quality": 15},
    "recommendation": {"data_grounding": 35, "specificity": 30, "interpretation_quality": 20, "benchmark_usage": 15},
    "data_quality": {"code_correctness": 30, "result_completeness": 30, "interpretation_quality": 25, "chart_appropriateness": 15},
    "benchmark": {"code_correctness": 30, "result_completeness": 30, "interpretation_quality": 25, "chart_appropriateness": 15},
}
UNSAFE_CODE = ("import os", "import sys", "subprocess", "open(", "__import__", "eval(", "exec(")

# --- fixed values: text corpus -------------------------------------------------
CHUNK_WORDS = 500
CHUNK_OVERLAP = 50
EMBEDDING_DIMS = 64
EMBEDDING_CHARS = "abcdefghijklmnopqrstuvwxyz0123456789 .,!?-_"
SEARCH_RESULTS = 5
MAX_DISTANCE = 1.2
MAX_CONTEXT_CHARS = 4000
MAX_BENCHMARK_CHARS = 2000
NOTE_SEPARATOR = "\n\n---\n\n"
BENCHMARK_LABEL = "FM Industry Benchmark — "
BENCHMARK_KEYWORDS = (
    ("win rate", ("win_rates", "win_rate")),
    ("win rates", ("win_rates", "win_rate")),
    ("sales cycle", ("sales_cycle_days", "sales_cycle")),
    ("pipeline", ("pipeline_health", "pipeline_coverage")),
    ("pipeline coverage", ("pipeline_health", "pipeline_coverage")),
    ("coverage ratio", ("pipeline_health", "pipeline_coverage")),
    ("revenue concentration", ("revenue_concentration",)),
    ("deal size", ("deal_size_brackets", "average_deal_size")),
    ("dormant", ("account_health", "dormant_account_days")),
    ("at risk", ("account_health",)),
    ("bid cost", ("pipeline_health",)),
)
BENCHMARKS = {
    "win_rates": {
        "competitive_tender": {"low": 15, "median": 28, "high": 40, "unit": "%", "source": "BIFM Annual Survey 2024"},
        "incumbent_renewal": {"low": 55, "median": 68, "high": 80, "unit": "%", "source": "BIFM Annual Survey 2024"},
        "framework_calloff": {"low": 30, "median": 47, "high": 60, "unit": "%", "source": "BIFM Annual Survey 2024"},
        "direct_award": {"low": 65, "median": 78, "high": 92, "unit": "%", "source": "BIFM Annual Survey 2024"},
    },
    "sales_cycle_days": {
        "under_100k": {"low": 20, "median": 45, "high": 75},
        "between_100k_500k": {"low": 60, "median": 135, "high": 200},
        "between_500k_2m": {"low": 150, "median": 270, "high": 400},
        "over_2m": {"low": 300, "median": 450, "high": 600},
    },
    "revenue_concentration": {
        "top_10_pct_accounts": {"typical": 65, "unit": "% of total revenue"},
        "top_20_pct_accounts": {"typical": 80, "unit": "% of total revenue"},
        "bottom_50_pct_accounts": {"typical": 7, "unit": "% of total revenue"},
    },
    "pipeline_health": {
        "coverage_ratio": {"healthy": 3.0, "warning": 2.0, "critical": 1.5, "unit": "pipeline value / revenue target"},
        "stale_opportunity_days": {"threshold": 90},
        "average_bid_cost_pct": {"low": 1.0, "typical": 2.0, "high": 3.5, "unit": "% of contract value"},
    },
    "deal_size_brackets": {
        "small": {"max": 100000, "label": "Small (<£100k)"},
        "mid": {"min": 100000, "max": 500000, "label": "Mid (£100k-£500k)"},
        "large": {"min": 500000, "max": 2000000, "label": "Large (£500k-£2M)"},
        "strategic": {"min": 2000000, "label": "Strategic (>£2M)"},
    },
    "account_health": {
        "dormant_threshold_days": 90,
        "at_risk_threshold_days": 60,
        "healthy_activity_days": 30,
    },
    "win_rate": {
        "fm_sector_median": "28% (BIFM 2024)",
        "fm_sector_top_quartile": "42% (BIFM 2024)",
        "hard_fm_median": "31% (BIFM 2024)",
        "soft_fm_median": "24% (BIFM 2024)",
    },
    "sales_cycle": {
        "fm_sector_median": "84 days (BIFM 2024)",
        "complex_deals_over_1m": "180 days (BIFM 2024)",
        "small_deals_under_100k": "45 days (BIFM 2024)",
    },
    "revenue_per_opportunity": {
        "fm_sector_median": "£125k (BIFM 2024)",
        "large_account_median": "£750k (BIFM 2024)",
    },
    "pipeline_coverage": {
        "fm_sector_recommended": "3x annual target (industry standard)",
        "healthy_ratio": "3.0-4.5x",
    },
    "average_deal_size": {
        "fm_sector_median": "£210k (BIFM 2024)",
        "facilities_management": "£310k (BIFM 2024)",
    },
    "dormant_account_days": {
        "fm_sector_typical": "90 days without activity = at risk",
    },
}

# fixed values: field, label and sign of the sections of a recommendation
RECOMMENDATION_SECTIONS = (
    ("priority_action", "PRIORITY ACTION", "🎯"),
    ("risk_flag", "RISK FLAG", "⚠️"),
    ("opportunity", "OPPORTUNITY", "💡"),
)
