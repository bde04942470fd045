"""Fixed values.

Thresholds, windows, labels and report cut points whose values must equal the
reference's for the results to mean the same thing. Operators take them as
parameter defaults; callers may override any of them.
"""

# --- fixed values (reference semantics) ---------------------------------
MAX_APPOINTMENT_MINUTES = 480          # contacts longer than 8 hours are entry errors
MAX_SALE_CREATION_GAP_DAYS = 30        # registrations with sale > creation + 30 days dropped
TOLERATED_GAP_DAYS = 7                 # gaps of 1..7 days are rounding tolerance
PURCHASE_GAP_ANOMALY_DAYS = 365        # first purchase vs first transaction
MIN_BIRTH_YEAR = 1900
MIN_AGE_YEARS = 18
MAX_AGE_YEARS = 100
DAYS_PER_YEAR = 365.25
RECENT_YEARS = 3                       # recent spend window (DT - 3y, DT]
PRIOR_YEARS = 6                        # prior spend window (DT - 6y, DT - 3y]
HOLIDAY_MONTHS = (2, 12)
SALE = "Sale"
REPAIR = "Repair"
BOUTIQUE = "Boutique"
CHANNELS = (BOUTIQUE, "Web", "CC")
ARTICLE_FLAGS = ("flag_he", "flag_bridal", "flag_diamond")
CLIENTELING = "Clienteling"
TREND_NO_PRIOR_WITH_RECENT = 2.0       # spend trend when only recent spend exists
TREND_NO_SPEND = 1.0
MISSING_REPORT_THRESHOLD_PCT = 5.0
HIGH_MISSING_SHARE = 0.5
NEAR_ZERO_SHARE = 0.99
HIGH_CORRELATION = 0.95
MAR_STD_THRESHOLD = 10.0
TARGET_PERCENTILES = (0.25, 0.50, 0.75, 0.90, 0.95, 0.99, 0.999)
CONCENTRATION_TOP_SHARES = (0.01, 0.05, 0.10, 0.20)
CAPTURE_TOP_SHARES = (0.01, 0.02, 0.05, 0.10, 0.20, 0.30)
TOP_DECILE = 0.10
RECONCILIATION_RATIO_RANGE = (0.5, 2.0)
LOGISTIC_C = 1.0
LOGISTIC_MAX_ITER = 300
LOGISTIC_TOLERANCE = 1e-8
# a category of more values stays an ordinal number in the trees
TREES_MAX_CATEGORIES = 256
TREES_MAX_DEPTH = 6
TREES_STEP = 0.05
TREES_SUBSAMPLE = 0.8
TREES_MIN_CHILD = 10
SAMPLE_SEED = 42
