"""Word lists, lookup tables and patterns that results depend on."""

# Per-language word replacements.
ORTHOGRAPHY = {
    "lin": {
        "eglize": "eglise",
        "katolikue": "catholique",
        "katholique": "catholique",
        "folele": "fololo",
        "molai": "molayi",
        "coulera": "culere",
    },
    "sna": {
        "mhombe": "mombe",
        "mudzumai": "mudzimai",
        "madzumai": "madzimai",
        "zvitsuku": "zvitsvuku",
    },
}

# Function words that may be deduplicated when repeated.
FUNCTION_SHORT = {
    "lin": ("ya", "na", "pe", "te", "ba", "ko", "se", "po", "mpe", "nde", "eza"),
    "lug": ("ne", "mu", "ku", "wa", "ya", "nga", "te", "si", "no", "wo", "ze", "be"),
    "sna": ("ne", "mu", "ku", "wa", "ya", "nga", "se", "pa", "ha", "ndi", "na", "uye"),
}

# Characters that end a generated text.
FOREIGN = "ĩũīūễафрикйця"

# Terminal fillers.
FILLERS = ("aa", "ah", "ee", "eh")

# Marker pattern -> weight, by group.
MARKERS = {
    "luo": (
        ("ng'", 3.0),
        ("dh", 2.0),
        ("th", 1.0),
        ("'", 1.5),
        (r"\btie\b", 2.0),
        (r"\bpi\b", 1.0),
        (r"\bachiel\b|\bariyo\b|\badek\b|\bang'wen\b", 2.0),
        (r"\bkod\b", 1.5),
        (r"\bmar\b", 1.0),
    ),
    "ach": (
        ("ŋ", 4.0),
        (r"\btye\b", 2.5),
        (r"\bpii\b", 2.0),
        (r"\bacel\b|\baryo\b|\badek\b|\bangwen\b", 2.0),
        (r"\bme\b", 1.0),
        (r"\bpa\b", 1.0),
    ),
    "lug": (
        (r"([a-z])\1", 1.5),
        (r"\bera\b", 2.0),
        (r"\bomu\b|\boku\b|\beki", 2.0),
    ),
}

# Foreign function words for the plausible-language filter.
ENGLISH_WORDS = r"(?i)\b(the|and|this|that|with|from|audio|test|approving|transcription|english)\b"

# Characters read as an apostrophe.
APOSTROPHES = "‘’ʼʻ`´"

# Language families of the class-probability model.
FAMILIES = {
    "luo": ("luo",),
    "ach": ("ach", "lwo", "alz"),
    "bantu": ("lug", "lin", "sna", "nyn", "sog", "swa", "swh", "nya", "kin", "xog"),
}
JUNK_CODES = ("eng", "fas", "wol", "ckb", "spa", "fra", "deu")

# Languages with a specialist system, and fallbacks for the others.
SPECIALISTS = (
    "lug", "lin", "sna", "ach", "sog", "nyn", "mas", "aka", "ewe", "ful",
    "orm", "amh", "tir", "wal", "dag", "dga", "kpo", "sid", "mlg",
)
FALLBACKS = {
    "luo": ("ach", "lug"),
    "swh": ("lug", "lin"),
    "swa": ("lug", "lin"),
    "kin": ("nyn", "lug"),
    "nya": ("sna", "lug"),
    "umb": ("sog", "lug"),
    "nso": ("sna", "lug"),
    "wol": ("ful", "lug"),
    "eng": ("lug", "lin", "sna"),
}
# Candidate systems by detected language.
CANDIDATES = {
    "luo": ("ach", "lug", "sog"),
    "lug": ("lug", "nyn", "sog"),
    "nyn": ("nyn", "lug"),
    "sog": ("sog", "lug"),
    "mas": ("mas", "lug"),
}
DOMAIN_LANGUAGES = ("lin", "sna", "lug", "ach", "nyn", "sog", "mas")

# Grid of the four-threshold calibration, in loop order.
MASS_GRID = {
    "min_a": (0.45, 0.50, 0.55, 0.60, 0.65, 0.70, 0.75, 0.80),
    "max_b": (0.10, 0.15, 0.20, 0.25, 0.30, 0.35),
    "min_margin": (0.10, 0.15, 0.20, 0.25, 0.30, 0.40),
    "max_c": (0.30, 0.40, 0.50, 0.60, 0.99),
}

# Grid of the distribution fits and of the decision table.
ECDF_GRID = tuple(round(0.05 * k, 2) for k in range(1, 20)) + (1.0, 1.5, 2.0, 3.0, 5.0, 8.0, 15.0, 30.0, 60.0, 120.0)
DECISION_GRID = (0.2, 0.25, 0.3, 0.4, 0.5, 0.75, 1.0)
SWAP_GAIN, SWAP_LOSS_B, SWAP_LOSS_C = 0.5692, 0.3137, 0.1767

# Reasons against an override, in the order of their tests.
ANOMALY_REASONS = (
    "dangling_one_character_terminal", "trailing_prefix_fragment", "localized_one_to_three_expansion",
    "production_oov_blowup_gt_0.10",
)

# Thresholds of the fallback policies; their names carry the value.
FALLBACK_RATIO_ABOVE = (1.20, 1.30, 1.40, 1.60, 1.80)
FALLBACK_RATIO_BELOW = (0.55, 0.65, 0.75, 0.85)
FALLBACK_SIMILARITY_BELOW = (0.40, 0.55, 0.70, 0.85)
