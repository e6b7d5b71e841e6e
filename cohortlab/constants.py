"""Fixed values that must equal the reference's for results to match.

Everything in this module is a plain constant, written out in natural order.
"""
from __future__ import annotations

# --- fixed values: raw table schema -------------------------------------------------
RAW_COLUMNS = [
    "permalink", "name", "homepage_url", "category_list", "funding_total_usd",
    "status", "country_code", "state_code", "region", "city",
    "funding_rounds", "founded_at", "first_funding_at", "last_funding_at",
]

# --- fixed values: status vocabulary and label map ------------------------------------
STATUS_ACQUIRED = "acquired"
STATUS_IPO = "ipo"
STATUS_CLOSED = "closed"
STATUS_OPERATING = "operating"
VALID_STATUSES = [STATUS_ACQUIRED, STATUS_IPO, STATUS_CLOSED, STATUS_OPERATING]
POSITIVE_STATUSES = [STATUS_ACQUIRED, STATUS_IPO]
NEGATIVE_STATUSES = [STATUS_CLOSED]

# --- fixed values: feature sets -------------------------------------------------------
LEAKY_COLUMNS = ["funding_total_usd", "funding_rounds", "last_funding_at"]
CLEAN_NUMERIC_FEATURES = ["founded_year", "time_to_first_funding_days"]
CLEAN_CATEGORICAL_FEATURES = ["country_code", "region", "primary_category"]
FULL_NUMERIC_FEATURES = CLEAN_NUMERIC_FEATURES + [
    "funding_total_usd_log1p", "funding_rounds", "funding_span_days",
]
FULL_CATEGORICAL_FEATURES = list(CLEAN_CATEGORICAL_FEATURES)
# Columns derived from the leaky raw columns; they may never enter the clean set.
LEAKY_FEATURES = ["funding_total_usd_log1p", "funding_rounds", "funding_span_days"]

MIN_FOUNDED_YEAR = 1900
SUSPECT_FOUNDED_YEAR = 1980
TEST_QUANTILE = 0.8

# --- fixed values: funding bands (right-closed) and age bands (left-closed) -----------
FUNDING_BIN_EDGES = [0, 100_000, 1_000_000, 10_000_000, 100_000_000, float("inf")]
FUNDING_BIN_LABELS = ["<$100K", "$100K-$1M", "$1M-$10M", "$10M-$100M", "$100M+"]
AGE_BIN_EDGES = [0, 2, 5, 10, 20, float("inf")]
AGE_BIN_LABELS = ["0-2y", "2-5y", "5-10y", "10-20y", "20y+"]
MIN_COHORT_SIZE = 30
TOP_N_GROUPS = 15
TOP_N_CATEGORIES = 20

# --- fixed values: Wilson z for the supported confidence levels -----------------------
WILSON_Z = {0.90: 1.6448536269514722, 0.95: 1.959963984540054, 0.99: 2.5758293035489004}

# --- fixed values: model / calibration knobs ------------------------------------------
CALIBRATION_FRACTION = 0.2
ISOTONIC_MIN_ROWS = 1000
CV_FOLDS = 5
CV_REPEATS = 10
THRESHOLD_BETA = 0.5
N_THRESHOLD_CANDIDATES = 99
N_CALIBRATION_BINS = 10
N_BOOTSTRAP = 200
BOOTSTRAP_CONFIDENCE = 0.90
DECISION_THRESHOLD_PCT = 65
PDP_GRID_POINTS = 30
PDP_FOUNDED_YEAR_FLOOR = 1980
TOP_N_CONTRIBUTIONS = 5
MAX_BATCH_SIZE = 100

# --- fixed values: chunking -----------------------------------------------------------
CHUNK_TARGET_WORDS = 200
CHUNK_OVERLAP_WORDS = 30
CHUNK_MAX_SECTION_WORDS = 400

# --- fixed values: retrieval ----------------------------------------------------------
TOKEN_PATTERN = "[a-zA-Z]{2,}"
# Suffix rules, tried in this order; first one leaving >= 3 letters wins.
SUFFIX_RULES = [("ies", "y"), ("ing", ""), ("ed", ""), ("es", ""), ("s", "")]
STEM_MIN_LEN = 3
RETRIEVAL_TOP_K = 8
RERANK_K = 3
MMR_LAMBDA = 0.6
MIN_RETRIEVAL_SCORE = 0.15

# --- fixed values: intent routing -----------------------------------------------------
GREETING_PATTERNS = [
    r"^\s*(hi|hello|hey|yo)\b", r"\bwhat can you do\b", r"\bhelp\b", r"\bwho are you\b",
]
ABOUT_PREDICTION_PATTERNS = [
    r"\b(my|this) (score|prediction|probability|result)\b", r"\bwhy (is|did|does) my\b",
    r"\bwhat hurts?\b", r"\bwhat helps?\b", r"\bdragging\b", r"\bwhat.s wrong with\b",
]
GENERAL_TOPIC_KEYWORDS = [
    "startup", "startups", "fundraising", "funding round", "series a", "series b", "series c",
    "pre-seed", "seed round", "survivorship", "calibration", "calibrated", "leakage",
    "investor", "traction", "venture capital", "vc ",
]
FEATURE_KEYWORDS = [
    ("funding_total_usd_log1p", ["funding", "money raised", "capital", "amount raised"]),
    ("funding_rounds", ["rounds", "number of rounds"]),
    ("funding_span_days", ["funding span", "time between rounds"]),
    ("founded_year", ["age", "old", "founded", "founding"]),
    ("time_to_first_funding_days", ["time to first funding", "first funding"]),
    ("country_code", ["country"]),
    ("region", ["region", "location"]),
    ("primary_category", ["category", "industry", "sector"]),
]
INTENTS = ["greeting", "about_prediction", "general", "out_of_scope"]

# --- fixed values: answer texts -------------------------------------------------------
CAPABILITY_STATEMENT = (
    "## What I can answer\n"
    "- Questions about your last prediction (\"why is my score low\", \"what hurts my score\").\n"
    "- General questions about startup fundraising and failure (\"why do startups fail\", \"what is a Series A\").\n"
    "- Questions about this model's own limitations (leakage, calibration, survivorship bias).\n"
    "I don't generate free-form advice - answers are grounded in your prediction's real numbers or in the "
    "cited local corpus, never invented."
)
NO_PREDICTION_TEXT = (
    "## No prediction yet\n"
    "I don't have a prediction to explain yet this session. Go to the **Predictor** tab, "
    "fill in a profile, and click Predict - then come back and ask again."
)
OUT_OF_SCOPE_TEXT = (
    "## Outside what I can answer\n"
    "That doesn't match a prediction question, a startup/fundraising topic in the local corpus, "
    "or a question about this model's limitations.\n\n"
)
RELATED_HEADER = "## Related context"
NOTHING_MATCHED_TEXT = "## Related context\nNothing in the local corpus matched this question."
NO_COHORT_TEXT = (
    "- Matching cohort: not enough comparable companies in the training data "
    "(n < 30 even at the country-alone level) to report a reliable rate."
)


# English stop words of the retrieval tokenizer, removed before stemming (alphabetical).
STOP_WORDS = tuple("""
a about above across after afterwards again against all almost alone along already also although always am among
amongst amoungst amount an and another any anyhow anyone anything anyway anywhere are around as at back be
became because become becomes becoming been before beforehand behind being below beside besides between beyond
bill both bottom but by call can cannot cant co con could couldnt cry de describe detail do done down due during
each eg eight either eleven else elsewhere empty enough etc even ever every everyone everything everywhere
except few fifteen fifty fill find fire first five for former formerly forty found four from front full further
get give go had has hasnt have he hence her here hereafter hereby herein hereupon hers herself him himself his
how however hundred i ie if in inc indeed interest into is it its itself keep last latter latterly least less
ltd made many may me meanwhile might mill mine more moreover most mostly move much must my myself name namely
neither never nevertheless next nine no nobody none noone nor not nothing now nowhere of off often on once one
only onto or other others otherwise our ours ourselves out over own part per perhaps please put rather re same
see seem seemed seeming seems serious several she should show side since sincere six sixty so some somehow
someone something sometime sometimes somewhere still such system take ten than that the their them themselves
then thence there thereafter thereby therefore therein thereupon these they thick thin third this those though
three through throughout thru thus to together too top toward towards twelve twenty two un under until up upon
us very via was we well were what whatever when whence whenever where whereafter whereas whereby wherein
whereupon wherever whether which while whither who whoever whole whom whose why will with within without would
yet you your yours yourself yourselves
""".split())

# The texts of a rendered facts answer.
FACTS_HEADER = "## What the model says"
FACTS_PROBABILITY = "- Calibrated probability of a positive outcome (acquired/IPO): **"
FACTS_BAND = "** (90% confidence band: "
FACTS_RAW = "- Raw model score (pre-calibration, log-odds space on the uncalibrated model): **"
FACTS_RAW_NOTE = "** - the contributions below decompose this number, not the calibrated one above."
FACTS_PERCENTILE = "- Percentile vs. the training cohort: **"
FACTS_TABLE_HEAD = ["| Feature | Value | SHAP | Direction |", "|---|---|---|---|"]
FACTS_FOREGROUND = "- You asked about `%s`: it %s the score (SHAP %+.3f, value = %s)."
FACTS_COHORT = "- Matching cohort ("
FACTS_COHORT_RATE = "): observed success rate **"
FACTS_COHORT_END = "** in the training data."

# Fixed value: the feature set of a request that names none.
DEFAULT_FEATURE_SET = "clean"
FEATURE_SETS = ("clean", "full")
PDP_TOP_CATEGORIES = 20
