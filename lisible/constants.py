"""Fixed values shared by the Spark plans and the SQL oracle.

Values that must equal the behaviour being reproduced are kept here, as
plain text, in natural order.
"""

# --- fixed values: CEFR levels, in rank order ------------------------------
LEVELS = ["A1", "A2", "B1", "B2", "C1", "C2"]

# --- fixed values: level maps ----------------------------------------------
# next-lower level used inside generation prompts (also four numbered levels)
PROMPT_REDUCED_LEVEL = {
    "A1": "A1", "A2": "A1", "B1": "A2", "B2": "B1", "C1": "B2", "C2": "C1",
    "level1": "level1", "level2": "level1", "level3": "level2", "level4": "level3",
}
# target level offered to a reader for an article at a given level
OFFERED_LEVEL = {"A1": "A1", "A2": "A1", "B1": "A2", "B2": "A2", "C1": "B1", "C2": "B1"}

# --- fixed values: catalog formatting --------------------------------------
TITLE_LENGTH = 60
DESCRIPTION_LENGTH = 300
CLIP_SUFFIX = "..."
TEXT_URL = "text"
TEXT_ICON = "https://cdn-icons-png.flaticon.com/512/2911/2911230.png"
DEFAULT_IMAGE = "https://static.thenounproject.com/png/2684410-200.png"
NO_DESCRIPTION = "No description"
# reading-time bands: minutes < 1, < 3, < 5, < 7, < 10, otherwise
READING_BAND_LIMITS = [1, 3, 5, 7, 10]

# --- fixed values: model limits ---------------------------------------------
SCORER_MAX_TOKENS = 512          # position count of the sentence classifier
GENERATION_BATCH_SIZE = 16
GENERATION_MIN_LENGTH = 128      # output limit is max(128, 2 * input length)
DEFAULT_GENERATOR = "rule-rewrite"

# --- scorer stand-in (readability index, not calibrated to CEFR) -----------
LIX_CENTRES = [20.0, 28.0, 36.0, 44.0, 52.0, 60.0]
LIX_SPREAD = 128.0
LIX_LONG_WORD = 7                # letters; "longer than six"

# decimals kept on floating outputs so Spark and the SQL oracle agree
FLOAT_DECIMALS = 6
