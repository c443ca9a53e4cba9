"""Fixed values. They must equal the published definitions for results to agree."""

# --- loan status, in business order -----------------------------------------
STATUS_ORDER = ["Active", "30 DPD", "60 DPD", "90+ DPD", "NPA", "Written-Off"]
STATUS_COLUMNS = {
    "Active": "active",
    "30 DPD": "dpd_30",
    "60 DPD": "dpd_60",
    "90+ DPD": "dpd_90_plus",
    "NPA": "npa",
    "Written-Off": "written_off",
}
BAD_STATUSES = ["NPA", "Written-Off"]
WATCH_STATUSES = ["30 DPD", "60 DPD"]

# --- currency units ---------------------------------------------------------
CRORE = 1e7
LAKH = 1e5

# --- credit score bands: lowest and highest score, both included ------------
SCORE_BANDS = [
    (None, 499, "300-499 (Poor)"),
    (500, 599, "500-599 (Fair)"),
    (600, 699, "600-699 (Good)"),
    (700, 749, "700-749 (Very Good)"),
]
SCORE_BAND_DEFAULT = "750+ (Excellent)"

# --- age bands: lowest and highest age, both included -----------------------
AGE_BANDS = [
    (None, 29, "< 30"),
    (30, 39, "30-39"),
    (40, 49, "40-49"),
]
AGE_BAND_DEFAULT = "50+"

# --- risk segments: least credit score, least annual income -----------------
RISK_SEGMENTS = [
    (720, 800000, "P1 - Prime"),
    (650, 400000, "P2 - Near-Prime"),
    (550, 200000, "P3 - Sub-Prime"),
]
RISK_SEGMENT_DEFAULT = "P4 - Deep Sub-Prime"

# --- debt-to-income bands: ratio below which the band applies ---------------
DTI_BANDS = [
    (0.20, "< 20% (Low Risk)"),
    (0.35, "20-35% (Moderate)"),
    (0.50, "35-50% (High)"),
]
DTI_BAND_DEFAULT = "> 50% (Very High)"

# --- first default: last payment number of the band -------------------------
DEFAULT_TIMING_LABELS = [
    "0-6 months (Early Default)",
    "7-12 months",
    "13-24 months",
]
DEFAULT_TIMING_CUTS = [6, 12, 24]
DEFAULT_TIMING_DEFAULT = "> 24 months"
DEFAULT_DAYS_LATE = 30

# --- repayment behaviour ----------------------------------------------------
COLLECTION_FROM = "2020-01-01"
COLLECTION_TO = "2023-12-31"
PARTIAL_TOLERANCE = 0.95
LATE_STREAK = 3

# --- loss given default -----------------------------------------------------
UNSECURED_PURPOSES = ["Personal Loan", "Education Loan", "Gold Loan"]
LGD_UNSECURED = 0.60
LGD_SECURED = 0.40

# --- watch-list -------------------------------------------------------------
WATCH_SCORE_BELOW = 650
WATCH_HIGH_SCORE_BELOW = 550
WATCH_MODERATE_SCORE_BELOW = 620
WATCH_HIGH_MIN_LOANS = 2
WATCH_HIGH = "HIGH RISK - Watch Immediately"
WATCH_MODERATE = "MODERATE RISK - Monitor Closely"
WATCH_STANDARD = "STANDARD MONITORING"

# --- report sizes -----------------------------------------------------------
TOP_EXPOSURES = 20
TOP_RANKED = 50
TOP_WATCHLIST = 30
HHI_TOTAL_LABEL = "TOTAL HHI INDEX"

# --- return features: window lengths in periods -----------------------------
MEAN_SHORT = 4
MEAN_LONG = 13
VOLATILITY = 4
MOMENTUM = 12
TRAIN_FRACTION = 0.75

# --- models -----------------------------------------------------------------
ELASTIC_NET = {"alpha": 0.0005, "l1_ratio": 0.5, "max_iter": 10000}
TREE = {"max_depth": 4, "min_leaf": 15}
BOOSTING = {"rounds": 200, "max_depth": 3, "learning_rate": 0.05}
FOREST = {"trees": 200, "max_depth": 5, "min_leaf": 5}
SEED = 42
COEF_LARGEST = 12
COEF_SMALLEST = 8

# --- backtest ---------------------------------------------------------------
COST_PER_TURN = 0.0005
PERIODS_PER_YEAR = 52
SHARPE_WINDOW = 52
TINY = 1e-9
AXIS_MARGIN = 1.1
