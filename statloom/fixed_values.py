"""Word lists, lookup tables, cut points and formats.

Results depend on these exact values, so they are kept together as plain text.
"""

# --- cleaning -------------------------------------------------------------

NULL_MARKERS = [
    "N/A", "NA", "n/a", "na", "None", "none", "null", "NULL", "NaN",
    "-", "#N/A", "#VALUE!", "?", ".", "", " ", "  ",
]
# Markers that count as missing when a text file is loaded; the others are found by the cleaning step.
LOAD_NULLS = ["", "#N/A", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]
NUMBER_NULL_TOKENS = ["", "N/A", "NA", "n/a", "na", "None", "null", "NULL", "-", "#N/A"]
CURRENCY_SYMBOLS = "$€£¥₦"
DATE_PATTERNS = [
    "yyyy-M-d", "d/M/yyyy", "M/d/yyyy", "d-M-yyyy", "yyyy/M/d",
    "MMM d yyyy", "MMMM d yyyy", "d MMM yyyy", "d MMMM yyyy", "yyyyMMdd",
]
# Readings of the generic date parser, tried after the others; month before day.
DATE_FALLBACK_PATTERNS = [
    "MMM d, yyyy", "MMMM d, yyyy", "d MMM, yyyy", "M/d/yyyy H:mm", "M/d/yyyy H:mm:ss", "d/M/yyyy H:mm", "d/M/yyyy H:mm:ss",
    "yyyy/M/d H:mm", "yyyy/M/d H:mm:ss",
]
BOOLEAN_TOKENS = ["true", "false", "yes", "no", "1", "0", "y", "n"]
IDENTIFIER_TOKENS = [
    "id", "code", "ref", "number", "no", "num", "email", "phone", "mobile", "tel",
    "transaction", "invoice", "order", "customer", "user", "account",
]
STUDY_IDENTIFIER_TOKENS = ["id", "code", "ref", "number", "no", "num"]
COLUMN_NAME_SYNONYMS = {
    "gender": "Gender", "sex": "Gender", "age": "Age", "age_years": "Age",
    "income": "Income", "salary": "Income", "wage": "Income",
    "education": "Education", "edu": "Education", "score": "Score",
    "total": "Total", "sum": "Total", "average": "Average", "mean": "Average",
    "count": "Count", "n": "Count",
}
BOOLEAN_SHARE, NUMERIC_SHARE, DATE_SHARE, CATEGORY_SHARE, CATEGORY_FLOOR = 0.85, 0.70, 0.60, 0.15, 10
MAX_ROWS, MAX_COLUMNS, MAX_FILE_MB, MAX_DOWNLOADS_PER_DAY = 100_000, 200, 50, 10
OUTLIER_FACTOR = 3.0
QUALITY_WEIGHTS = {"missing": 35, "outlier": 20, "bad_date": 15, "duplicate": 20, "mixed": 100}

# --- statistics -----------------------------------------------------------

STAR_CUTS = [(0.001, "***"), (0.01, "**"), (0.05, "*")]
EFFECT_CUTS = {
    "cramers_v": ([(0.1, "negligible"), (0.3, "small"), (0.5, "moderate")], "large"),
    "cohens_d": ([(0.2, "negligible"), (0.5, "small"), (0.8, "medium")], "large"),
    "eta_squared": ([(0.06, "small"), (0.14, "medium")], "large"),
    "correlation": ([(0.1, "negligible"), (0.3, "weak"), (0.5, "moderate"), (0.7, "strong")], "very strong"),
    "alpha": ([(0.5, "unacceptable"), (0.6, "poor"), (0.7, "questionable"), (0.8, "acceptable"), (0.9, "good")],
              "excellent"),
}
SKEW_CUT = 0.5
NORMALITY_ROW_LIMIT = 5000
SOUND_SCORE = 0.6
REVIEW_SCORE = 0.8
STUDY_TESTS = {
    "descriptive": "Descriptive Statistics",
    "chi_square": "Chi-Square Test of Independence",
    "t_test": "Independent Samples T-Test",
    "anova": "One-Way ANOVA",
    "correlation": "Correlation Analysis",
    "regression": "Linear Regression",
    "reliability": "Reliability Analysis (Cronbach's Alpha)",
}

# --- accounts -------------------------------------------------------------

PRICES = [
    ("cleaning", "Data Cleaning", 0),
    ("descriptive", "Descriptive Statistics", 0),
    ("chi_square", "Chi-Square Test", 1),
    ("correlation", "Correlation Analysis", 1),
    ("t_test", "T-Test", 1),
    ("mann_whitney", "Mann-Whitney U Test", 1),
    ("anova", "ANOVA", 2),
    ("kruskal_wallis", "Kruskal-Wallis Test", 2),
    ("regression", "Linear Regression", 3),
    ("multiple_regression", "Multiple Regression", 4),
    ("logistic_regression", "Logistic Regression", 5),
    ("pca", "Principal Component Analysis (PCA)", 5),
    ("factor_analysis", "Factor Analysis", 6),
    ("arima", "Time Series Forecasting (ARIMA)", 8),
    ("reliability", "Reliability Test (Cronbach's Alpha)", 3),
    ("ai_interpretation", "AI-Powered Interpretation", 1),
    ("export_docx", "APA Word Export", 1),
    ("export_pdf", "PDF Export", 1),
    ("export_xlsx", "Excel Export", 0),
    ("thesis_package", "Full Research / Thesis Package", 12),
]
RATES = [("NGN", 1530.0), ("GBP", 0.79), ("EUR", 0.92), ("KES", 129.0), ("GHS", 15.5), ("ZAR", 18.2), ("USD", 1.0)]
CURRENCY_PREFIX = [("USD", "$"), ("NGN", "₦"), ("GBP", "£"), ("EUR", "€"), ("KES", "KSh"), ("GHS", "GH₵"), ("ZAR", "R")]
COUNTRIES = [
    ("NG", "NGN", "paystack"), ("GH", "GHS", "lemonsqueezy"), ("KE", "KES", "lemonsqueezy"),
    ("ZA", "ZAR", "lemonsqueezy"), ("GB", "GBP", "lemonsqueezy"), ("US", "USD", "lemonsqueezy"),
]
DEFAULT_COUNTRY = ("USD", "lemonsqueezy")
PACKS = [("pack_5", 5, 5, "5 Credits"), ("pack_15", 15, 13, "15 Credits"),
         ("pack_40", 40, 32, "40 Credits"), ("pack_100", 100, 75, "100 Credits")]
PLANS = [("student", 5, 20), ("researcher", 15, 100), ("professional", 30, -1)]
MILESTONES = [(3, "5 free credits"), (10, "1 free Thesis Package")]
ACTIVITY_ACTIONS = ["analysis_run", "analysis_saved", "thesis_package_generated"]
ALLOWANCE_PERIOD_DAYS = 30
SHARE_LINK_DAYS = 30
USER_AGENT_LENGTH = 300
VARIABLE_KEYS = ["numeric_var", "group_var", "var1", "var2", "dependent", "predictors", "columns"]
