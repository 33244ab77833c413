"""Run configuration: column lists, thresholds and constants in one frozen object.

Every operator takes its column names and parameters from a ``BiasConfig``
instead of module globals, so one Spark job can evaluate several
configurations side by side.
"""

from __future__ import annotations

from dataclasses import dataclass

# ---------------------------------------------------------------------------
# These must equal the modelled pipeline's for results to match.
# ---------------------------------------------------------------------------

# Identity (subgroup) columns, in reporting order.
IDENTITY_COLUMNS = (
    "male", "female", "homosexual_gay_or_lesbian", "christian", "jewish",
    "muslim", "black", "white", "psychiatric_or_mental_illness",
)

# Auxiliary targets; the first one is the main toxicity target.
AUX_COLUMNS = ("target", "severe_toxicity", "obscene", "identity_attack", "insult", "threat")

# Code points that the cleaning step replaces by one blank each (hex):
# 2028 2061 202c 200d 200f 9d 2005 202a 2009 2004 10 200b 200c ad 202f 200e
# feff f0d8 7f a0 200a 0d 2007 2002 3000 2006 2003
SPACE_CHARS = (
    "\u2028\u2061\u202c\u200d\u200f\x9d\u2005\u202a\u2009\u2004"
    "\x10\u200b\u200c\xad\u202f\u200e\ufeff\uf0d8\x7f\xa0"
    "\u200a\r\u2007\u2002\u3000\u2006\u2003"
)

# Smiley patterns counted by the ``num_smilies`` feature.
SMILIES = (":)", ":-)", ";-)", ";)")

# Character sets of the punctuation and symbol counters.
PUNCTUATION_CHARS = ".,;:"
SYMBOL_CHARS = "*&$%"

# Meta-feature output order (``num_symbols`` last, unlike creation order).
FEATURE_COLUMNS = (
    "total_length", "capitals", "caps_vs_length", "num_exclamation_marks",
    "num_question_marks", "num_punctuation", "num_words", "num_unique_words",
    "words_vs_unique", "num_smilies", "num_symbols",
)

# Bias metric: power-mean exponent and weight of the overall AUC.
POWER = -5.0
OVERALL_MODEL_WEIGHT = 0.25
BINARY_THRESHOLD = 0.5

# Reserved token ids of the sequence encoder.
PAD_ID, UNK_ID, CLS_ID, SEP_ID = 0, 1, 2, 3

# Name of the pseudo-subgroup that carries the overall AUC.
OVERALL = "__all__"

# Run sweep of the modelled training scripts (run, model, depth, maxlen,
# batch size, accumulation steps, seed).
RUN_SWEEP = (
    ("train_1", "bert", 12, 220, 32, 4, 17493),
    ("train_2", "bert", 11, 300, 32, 4, 9628),
    ("train_3", "bert", 12, 220, 32, 4, 7328),
    ("train_4", "bert", 12, 300, 32, 4, 7782),
    ("train_5", "bert", 11, 220, 128, 1, 6037),
    ("train_gpt2", "gpt2", 12, 300, 96, 2, 4853),
    ("train_xlnet", "xlnet", 16, 220, 16, 8, 9374),
)


@dataclass(frozen=True)
class BiasConfig:
    identity_columns: tuple[str, ...] = IDENTITY_COLUMNS
    aux_columns: tuple[str, ...] = AUX_COLUMNS
    toxicity_column: str = "target"
    id_column: str = "id"
    text_column: str = "comment_text"
    score_column: str = "prediction"
    power: float = POWER
    overall_model_weight: float = OVERALL_MODEL_WEIGHT
    threshold: float = BINARY_THRESHOLD
    max_sequence_length: int = 220
    batch_size: int = 32
    accumulation_steps: int = 4
    train_percent: float = 0.7
    valid_percent: float = 0.05
    epochs: int = 2
    seed: int = 94285
    # Background rule of the sample weight: "any" identity below the
    # threshold (the modelled behaviour) or "all" of them.
    strict_background: bool = False


DEFAULT = BiasConfig()
