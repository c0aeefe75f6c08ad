"""Values that decide results and therefore may not drift.

Everything here is a fixed value: limits, word lists, label tables, prompt
texts and published scores. Code elsewhere imports them; nothing is derived.
"""

# --- fixed values: limits -------------------------------------------------
CHUNK_SIZE = 512
CHUNK_OVERLAP = 64
TOP_K = 5
MAX_DISTANCE = 1.2
HASHED_DIM = 384
MAX_HISTORY = 500
PROMPT_HISTORY = 20
PROMPT_TOKENS = 512
SFT_TOKENS = 512
FORECAST_TOKENS = 2048
ANSWER_PREVIEW = 200
PASSAGE_PREVIEW = 80
DEFAULT_TEST_SHARE = 0.25
SCORE_TASK_TEST_SHARE = 0.226
SPLIT_SEED = 42
EFFECTIVE_BATCH = 16
EPOCHS = 3
IGNORED_LABEL = -100
QUARTERS_KEPT = 8
YEARS_KEPT = 4
NEWS_KEPT = 10

# --- fixed values: whitespace removed by trimming (what str.strip removes) --
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# --- fixed values: statuses -------------------------------------------------
OK = "ok"
EMPTY_INDEX = "empty_index"
NO_MATCH = "no_match"
LOW_CONFIDENCE = "low_confidence"
ERROR = "error"

# --- fixed values: status messages (low confidence is built from parts) -----
EMPTY_INDEX_MSG = "RAG index is empty. Index documents first with append_index()."
ERROR_MSG = "RAG retrieval raised an exception. Check logs for details."
NO_MATCH_MSG = "RAG found no candidate chunks in the index."

# --- fixed values: warnings shown beside an answer --------------------------
EMPTY_INDEX_WARNING = "No documents indexed. Answer based on model knowledge only."
NO_MATCH_WARNING = (
    "No relevant documents found in index. Answer based on model knowledge only."
)
LOW_CONFIDENCE_WARNING = "Retrieved documents were not sufficiently relevant. "

# --- fixed values: system prompts -------------------------------------------
BASE_SYSTEM = (
    "You are an expert financial analyst. "
    "Reason carefully, cite your logic, and provide structured, professional analysis."
)
CONTEXT_INTRO = (
    "\n\n--- RELEVANT FINANCIAL CONTEXT ---\n"
    "The following excerpts were retrieved from indexed financial documents.\n"
    "Use them to inform your analysis where relevant. If they contradict each other,\n"
    "note the discrepancy. If they are irrelevant to the query, ignore them.\n\n"
)
CONTEXT_END = "\n--- END CONTEXT ---"
FORECAST_SYSTEM = (
    "You are a seasoned stock market analyst. Your task is to list the positive "
    "developments and potential concerns for companies based on relevant news and "
    "basic financials from the past weeks, then provide an analysis and prediction "
    "for the companies' stock price movement for the upcoming week. "
    "Your answer format should be as follows:\n\n"
    "[Positive Developments]:\n1. ...\n\n"
    "[Potential Concerns]:\n1. ...\n\n"
    "[Prediction & Analysis]:\n..."
)

# --- fixed values: routing words, first matching group wins -----------------
ROUTES = [
    ("forecaster", ["forecast", "predict", "next week", "price target",
                    "stock movement", "will rise", "will fall"]),
    ("sentiment", ["sentiment", "bullish", "bearish",
                   "what is the tone", "classify this"]),
    ("multitask", ["headline", "price going up", "price going down",
                   "does this headline"]),
]
DEFAULT_AGENT = "multitask"

# --- fixed values: agents (name, rank, description, available) --------------
AGENTS = [
    ("sentiment", 8, "Financial sentiment specialist (positive/neutral/negative)", True),
    ("multitask", 16, "Multi-task: sentiment, financial Q&A, headline classification", True),
    ("forecaster", 16, "Stock price movement forecasting", False),
]

# --- fixed values: evaluation instructions ----------------------------------
NEWS_INSTRUCTION = (
    "What is the sentiment of this news? "
    "Please choose an answer from {negative/neutral/positive}."
)
TWEET_INSTRUCTION = (
    "What is the sentiment of this tweet? "
    "Please choose an answer from {negative/neutral/positive}."
)

# --- fixed values: label tables ---------------------------------------------
PHRASEBANK_LABELS = {0: "negative", 1: "neutral", 2: "positive"}
TWEET_LABELS = {0: "negative", 1: "positive", 2: "neutral"}
SEVEN_CLASS_LABELS = {
    "strong negative": "negative",
    "moderately negative": "negative",
    "mildly negative": "neutral",
    "neutral": "neutral",
    "mildly positive": "neutral",
    "moderately positive": "positive",
    "strong positive": "positive",
}
NEGATIVE_BELOW = -0.1
POSITIVE_FROM = 0.1

# --- fixed values: open questions (question, expected keywords, difficulty) --
QA_CASES = [
    ("What is the relationship between interest rates and bond prices?",
     ["inverse", "fall", "rise", "yield", "price", "duration"], "core"),
    ("What does the P/E ratio indicate about a stock?",
     ["earnings", "price", "valuation", "multiple", "overvalued", "undervalued"], "core"),
    ("Explain the difference between a bull market and a bear market.",
     ["rise", "fall", "bull", "bear", "decline", "growth", "optimism", "pessimism"], "core"),
    ("What is quantitative easing and what are its effects?",
     ["money", "supply", "central bank", "bonds", "inflation", "liquidity", "stimulus"],
     "intermediate"),
    ("What are the key risks when investing in emerging market equities?",
     ["currency", "political", "volatility", "liquidity", "regulatory", "risk"],
     "intermediate"),
    ("How does the yield curve inversion signal a recession?",
     ["short", "long", "invert", "recession", "rates", "term", "predict"], "advanced"),
    ("What is the difference between systematic and unsystematic risk?",
     ["market", "diversif", "specific", "beta", "portfolio", "company"], "advanced"),
    ("Explain how a discounted cash flow (DCF) model works.",
     ["cash flow", "discount", "present value", "rate", "terminal", "future"], "advanced"),
]

# --- fixed values: published F1 scores (task, system, score or None) ---------
PUBLISHED_SCORES = [
    ("FPB", "published", 0.882),
    ("FPB", "BloombergGPT", 0.511),
    ("FPB", "GPT-4", 0.833),
    ("FiQA-SA", "published", 0.874),
    ("FiQA-SA", "BloombergGPT", None),
    ("FiQA-SA", "GPT-4", 0.630),
    ("TFNS", "published", 0.903),
    ("TFNS", "BloombergGPT", None),
    ("NWGI", "published", 0.643),
    ("NWGI", "BloombergGPT", None),
    ("Headline", "published", 0.970),
    ("Headline", "BloombergGPT", None),
]

# --- fixed values: sections of a forecast answer ------------------------------
FORECAST_SECTIONS = (
    "[Positive Developments]",
    "[Potential Concerns]",
    "[Prediction & Analysis]",
)

# --- fixed values: reasoning end marker ---------------------------------------
THINK_END = "</think>"
