"""Parameters. Everything tunable is a frozen dataclass; operators take one as an argument."""

from __future__ import annotations

from dataclasses import dataclass, field

# --------------------------------------------------------------------------
# Results depend on these exact lists, patterns and numbers.
# --------------------------------------------------------------------------

AXES: dict[str, tuple[str, ...]] = {
    "length": ("short", "long"),
    "sentiment": ("positive", "negative"),
    "structure": ("structured", "unstructured"),
    "example_mode": ("few_shot", "zero_shot"),
}

ASPECT_PATTERNS: dict[str, str] = {
    "the location": r"\b(?:locat|neighborhood|nearby|walk(?:ing)?\s+distance|block[s]?\s+from|downtown|close to|around the corner|steps from)",
    "the price / value for money": r"\b(?:price[ds]?|pricing|cost|rate[s]?|value|expensive|cheap|afford|worth (?:it|the)|for what (?:we|i) paid|bargain|overpriced)",
    "room cleanliness": r"\b(?:clean|dirt(?:y|ier)|spotless|stain|dust|grime|hygien|immaculate|filth|housekeeping|tidy)",
    "how long the stay was": r"\b(?:\d+\s*(?:night|day|week)|one night|two nights|three nights|a week|weekend|stayed for|our stay|overnight)",
    "the staff": r"\b(?:staff|reception|front desk|concierge|manager|employee|housekeep|bellhop|porter|check[- ]?in)",
    "noise levels": r"\b(?:nois(?:e|y)|quiet|loud|sound(?:proof)?|hear(?:d|ing)?\s|thin walls|traffic outside|silent|peaceful)",
    "breakfast": r"\b(?:breakfast|buffet|continental|morning meal|coffee (?:bar|station)|omelet|pastri)",
}

OPENER_MOVES: tuple[tuple[str, int], ...] = (
    ("first person singular, starting with the word I", 3),
    ("first person plural, starting with the word We or Our", 3),
    ("the room or the hotel itself as the subject", 2),
    ("a time or occasion, such as a month, a season, or a trip event", 2),
    ("the reason for the trip", 1),
    ("a verdict stated up front", 1),
    ("a specific detail or small incident", 1),
)

SINGULAR_OPENERS = ("i", "i'm", "i've", "my")
PLURAL_OPENERS = ("we", "we've", "our", "us")
DEFAULT_OPENERS = ("i", "i'm", "i've", "we", "my", "our")

REASONING_PATTERN = r"<think(?:ing)?>.*?</think(?:ing)?>\s*|<thought>.*?</thought>\s*"
PREAMBLE_PATTERN = r"\s*(?:sure[,!]?|certainly[,!]?|of course[,!]?|here(?:'s| is)[^:\n]*|review)\s*[:\-—]\s*"
PREAMBLE_LEAK_PATTERN = r"^\s*(?:sure|certainly|of course|here(?:'s| is)|review\s*:)"
DISCLOSURE_PATTERN = r"\b(?:as an ai|language model|i cannot|i'm unable to|generated by)"

TYPOGRAPHY: dict[str, str] = {
    "—": "--",
    "–": "-",
    "‒": "-",
    "―": "--",
    "‘": "'",
    "’": "'",
    "‚": "'",
    "“": "'",
    "”": "'",
    "„": "'",
    '"': "'",
    "…": "...",
    "\u00a0": " ",
    "\u2009": " ",
    "\u202f": " ",
    "′": "'",
    "″": "'",
    "´": "'",
    "`": "'",
}

CJK_PUNCTUATION = "，。、！？；：（）「」『』【】"
LAST_LATIN_CODE_POINT = 0x024F

GENERATED_COLUMNS: tuple[str, ...] = (
    "Binary_label", "Category", "domain", "text", "is_synthetic", "model",
    "length", "sentiment", "structure", "example_mode", "opener_move", "cell_id",
    "rep_index", "n_chars", "n_words", "target_chars", "in_length_band",
    "n_attempts", "gen_temperature", "gen_seed", "timestamp",
)
REQUIRED_CORPUS_COLUMNS = ("Binary_label", "Category", "text", "source")
LEAKY_COLUMNS = ("model", "is_synthetic")

SVM_GRID: dict[str, list] = {
    "C": [0.1, 1.0, 10.0],
    "kernel": ["linear", "rbf"],
    "gamma": ["scale", 0.01, 0.001],
    "class_weight": [None, "balanced"],
}
TREES_GRID: dict[str, list] = {
    "n_estimators": [200, 400, 800],
    "max_depth": [3, 5, 7],
    "learning_rate": [0.03, 0.10],
    "subsample": [0.8, 1.0],
    "colsample_bytree": [0.8, 1.0],
    "min_child_weight": [1, 3],
    "reg_lambda": [1, 5],
}
TRANSFORMER_GRID: dict[str, list] = {
    "learning_rate": [2.0e-5, 3.0e-5, 5.0e-5],
    "batch_size": [8, 16],
    "num_train_epochs": [3, 4],
    "weight_decay": [0.0, 0.01],
}

# --------------------------------------------------------------------------
# Parameters with defaults.
# --------------------------------------------------------------------------


@dataclass(frozen=True)
class LengthTarget:
    chars: int
    words: tuple[int, int]


@dataclass(frozen=True)
class Design:
    """A factorial collection design and the seeded draws made for each of its rows."""

    axes: dict[str, tuple[str, ...]] = field(default_factory=lambda: dict(AXES))
    targets: dict[str, LengthTarget] = field(
        default_factory=lambda: {
            "short": LengthTarget(200, (20, 35)),
            "long": LengthTarget(700, (110, 140)),
        }
    )
    tolerance: float = 0.35
    aspects: tuple[str, ...] = tuple(ASPECT_PATTERNS)
    aspects_per_text: int = 4
    moves: tuple[tuple[str, int], ...] = OPENER_MOVES
    seed: int = 12


@dataclass(frozen=True)
class ExampleSpec:
    """Where few-shot examples come from and which length quantiles suit each condition."""

    real_label: str = "real"
    fake_label: str = "fake"
    real_source_by_sentiment: dict[str, str] = field(
        default_factory=lambda: {"positive": "TripAdvisor", "negative": "Web"}
    )
    fake_source: str = "MTurk"
    quantiles: dict[str, tuple[float, float]] = field(
        default_factory=lambda: {"short": (0.0, 0.25), "long": (0.25, 0.75)}
    )


@dataclass(frozen=True)
class AttemptSpec:
    """How collected attempts are graded."""

    min_words: int = 10
    error_chars: int = 20
    trim_overlong: bool = True
    normalize: bool = True
    adherence_floor: float = 0.6


@dataclass(frozen=True)
class SplitSpec:
    train: float = 0.70
    validation: float = 0.15
    seed: int = 42


@dataclass(frozen=True)
class VectorSpec:
    """Vocabulary limits: ``min_df`` texts at least, ``max_df`` share of texts at most."""

    ngrams: tuple[int, int] = (1, 2)
    min_df: int = 2
    max_df: float = 0.95
    cap: int = 100_000
    strip_accents: bool = True


@dataclass(frozen=True)
class PromptTemplates:
    """Caller-supplied wording. Placeholders: item, sentiment, chars, w_min, w_max, lo, hi,
    aspects, move, real_example, fake_example."""

    opening: str
    sentiment: str
    length: dict[str, str]
    structured: str
    unstructured: str
    opener: str
    closing: str
    few_shot: str
    zero_shot: str
