"""Constants that must be equal for equal results.

Word lists, patterns and small lookup tables only; no logic. Larger vocabularies (the alias
table of the traits) are read from a table the caller supplies.
"""

# Normalised raw values that mean "not recorded".
MISSING_WORDS = (
    "", "n a", "na", "none", "ninguno", "ninguna", "no aplica", "not applicable", "not visible",
    "no visible", "no visibles", "not observed", "no observado", "unclear", "no claro", "no",
    "unknown", "desconocido", "cannot determine", "no se puede determinar",
)
# Words that negate a compound value.
NEGATIONS = ("not", "no", "non", "sin", "without")
# Characters that become spaces when text is normalised.
PUNCTUATION = ",;./[](){}"
# Answers that count as abstentions.
ABSTENTIONS = ("unclear", "not visible", "cannot determine", "n/a", "na", "")
# Subtype -> parent value.
SUBTYPES = {
    "serrate": "toothed", "dentate": "toothed", "crenate": "toothed", "serrulate": "toothed",
    "denticulate": "toothed", "clustered": "whorled", "not observed": "absent",
}
# Raw values that carry no prediction for a matrix category.
EMPTY_PREDICTIONS = ("n/a", "not visible", "unclear", "unknown", "cannot determine", "not observed", "none")
# Uninformative trait values in queries and evidence.
UNINFORMATIVE = ("unclear", "n/a", "not observed", "not visible")
# Number of a form line -> (section, field).
FORM_FIELDS = {
    1: ("leaf_arrangement", "relative_position"), 2: ("leaf_arrangement", "spacing"),
    3: ("leaf_complexity", "type"), 4: ("leaf_complexity", "compound_type"),
    5: ("leaf_complexity", "num_leaflets"), 6: ("leaf_complexity", "leaflet_arrangement"),
    7: ("leaf_morphology", "margin"), 8: ("leaf_morphology", "shape"), 9: ("leaf_morphology", "apex"),
    10: ("leaf_morphology", "base"), 11: ("leaf_morphology", "venation"),
    12: ("leaf_morphology", "secondary_veins"), 13: ("leaf_morphology", "surface_features"),
    14: ("leaf_morphology", "trichomes"), 15: ("leaf_morphology", "petiole_length"),
    16: ("leaf_morphology", "petiole_features"), 17: ("stem_traits", "type"),
    18: ("stem_traits", "trichomes"), 19: ("stem_traits", "color"), 20: ("stem_traits", "texture"),
    21: ("special_features", "stipules"), 22: ("special_features", "latex"),
    23: ("special_features", "pulvinus"), 24: ("special_features", "tendrils"),
}
# Matrix rules (option column, section, field, words that select the option).
MATRIX_RULES = (
    ("leaf_arrangement__alternate", "leaf_arrangement", "relative_position", ("alternate",)),
    ("leaf_arrangement__opposite", "leaf_arrangement", "relative_position", ("opposite",)),
    ("leaf_arrangement__whorled_or_clustered", "leaf_arrangement", "relative_position", ("whorled",)),
    ("leaf_type__simple", "leaf_complexity", "type", ("simple",)),
    ("leaf_type__compound", "leaf_complexity", "type", ("compound",)),
    ("leaf_margin__entire", "leaf_morphology", "margin", ("entire",)),
    ("leaf_margin__toothed", "leaf_morphology", "margin",
     ("toothed", "dentate", "serrate", "crenate", "serrulate", "denticulate")),
    ("leaf_margin__lobed", "leaf_morphology", "margin", ("lobed", "palmately lobed", "pinnatifid")),
    ("stipules__present", "special_features", "stipules", ("present",)),
    ("stipules__absent", "special_features", "stipules", ("absent",)),
    ("latex__present", "special_features", "latex", ("present",)),
    ("latex__absent", "special_features", "latex", ("absent",)),
)
# Image file suffixes.
IMAGE_SUFFIXES = (".jpg", ".jpeg", ".png", ".webp")
# Correction ranks and categories.
RANKS = ("family", "genus", "species")
CORRECTION_CATEGORIES = ("typo", "variant", "synonym")
# Habit -> liana flag.
HABIT_FLAG = {"Climbing": 1, "Freestanding": 0}
# Verdicts of a matrix grade, most informative first.
VERDICTS = ("correct", "incorrect", "skipped_not_observed", "skipped_no_prediction", "skipped_uncoded")
# Suffixes cut from a model name.
MODEL_SUFFIXES = ("-Instruct-FP8", "-A3B-FP8", "-Instruct", "-FP8")
