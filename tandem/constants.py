"""Fixed values that must equal the published behaviour for results to match.

Everything in this module is a literal the outputs depend on (prompt texts,
batch sizes, id formats, whitespace set, model registry, table layout).
Keep them together and in natural order; operators import them by name.
"""

# --- FIXED VALUES: generation settings ------------------------------------
BATCH_SIZE = 30  # pairs requested per model call
EXAMPLES_PER_CALL = 15  # few-shot examples shown per call
MAX_ATTEMPTS = 5  # attempts per batch before it is skipped
SYNTHETIC_ORIGIN = "gemini_synthetic"  # dataset_origin of generated rows

# --- FIXED VALUES: id formats (printf style; never lpad, which truncates) ----
ID_FORMAT_1X = "gem1_s%05d"
ID_FORMAT_5X = "gem5_s%06d"

# --- FIXED VALUES: split sizes of the published corpus, in order -----------
# training / validation / test / evaluation, taken from half the corpus.
SPLIT_NAMES = ("training", "validation", "test", "evaluation")
SPLIT_WEIGHTS = (16926, 2000, 2000, 2000)

# --- FIXED VALUES: Python str.isspace() characters -------------------------
# \t \n \v \f \r, U+001C..U+001F, space, U+0085, U+00A0, U+1680,
# U+2000..U+200A, U+2028, U+2029, U+202F, U+205F, U+3000.
# Written as a regex class understood by both Java regex and RE2.
WS_CLASS = (
    r"[\x{09}-\x{0d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)
NON_WS_CLASS = "[^" + WS_CLASS[1:]

# --- FIXED VALUES: prompt texts --------------------------------------------
SRC_LANG = "Luganda"
TGT_LANG = "English"
ZERO_SHOT_PREFIX = "Translate the following from Luganda to English: "
RESPONSE_TEMPLATE = "\nEnglish:"  # completion starts after its last occurrence
TRAIN_TARGET_PREFIX = "\nEnglish: "

# Few-shot generation prompt. %1$d = example count, %2$s = example block,
# %3$d = pairs requested. Each example renders as
# "  English: {english}\n  Luganda:  {luganda}", joined by "\n".
FEWSHOT_EXAMPLE_FORMAT = "  English: %s\n  Luganda:  %s"
FEWSHOT_TEMPLATE = (
    "You are a bilingual linguistic expert in English and Luganda "
    "(a Bantu language spoken in Uganda).\n"
    "\n"
    "Below are %d real English-Luganda sentence pairs from a curated dataset:\n"
    "\n"
    "%s\n"
    "\n"
    "Your task: generate %d NEW English-Luganda sentence pairs.\n"
    "\n"
    "Rules:\n"
    "- Every sentence must be original - do NOT copy or closely paraphrase any example above.\n"
    "- Vary topics (daily life, health, education, agriculture, greetings, commerce, family, etc.)\n"
    "- Vary sentence length (short to medium; avoid very long sentences)\n"
    "- Vary formality (conversational and formal registers both welcome)\n"
    "- Luganda translations must be accurate and natural\n"
    "- Do NOT include numbering, bullet points, or extra commentary\n"
    "\n"
    "Respond ONLY with a valid JSON array, no markdown fences, like this:\n"
    "[\n"
    '  {"english": "...", "luganda": "..."},\n'
    '  {"english": "...", "luganda": "..."}\n'
    "]"
)

# --- FIXED VALUES: token limits --------------------------------------------
MAX_INPUT_TOKENS_ZERO_SHOT = 512
MAX_SEQ_TOKENS = 2048
MAX_NEW_TOKENS = 256

# --- FIXED VALUES: model registry (key -> weights path) ---------------------
MODEL_REGISTRY = (
    ("llama3", "/models/Llama-3.1-8B"),
    ("mistral", "/models/Mistral-7B-v0.3"),
    ("aya", "/models/aya-23-8B"),
    ("gemma", "/models/gemma-7b"),
)

# --- FIXED VALUES: condition summary table ----------------------------------
SUMMARY_HEADER = "Condition  | Method | Data | COMET  | Examples | Status"
SUMMARY_SEPARATOR = "-----------|--------|------|--------|----------|--------"
SUMMARY_ROW_FORMAT = "%-10s | %-6s | %-4s | %-6s | %-8s | %s"
MISSING_SCORE_CELL = "  -   "
ERROR_TEXT_LIMIT = 250

# --- FIXED VALUES: training loop --------------------------------------------
EARLY_STOPPING_PATIENCE = 2
DEFAULT_EPOCH_BUDGET = 5

# --- FIXED VALUES: run metric keys -------------------------------------------
METRIC_MEAN = "comet_mean"
