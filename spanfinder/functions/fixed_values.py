"""Word lists, patterns and constants that decide the results.

They are stated once, here, so that the expressions elsewhere stay free of literals.
"""

# --- fixed values: query planning patterns -------------------------------------------------

LEAD = (
    r"^\s*(?:please\s+)?(?:can you\s+)?(?:find|show|search(?: for)?|locate|get|give)\s*(?:me)?\s*"
    r"(?:the\s+)?(?:all\s+)?(?:parts?|moments?|clips?|scenes?|places?|points?|segments?|times?|videos?)?\s*"
    r"(?:where|when|in which|of|that|with)?\s*"
)
SPEAKER = (
    r"\b(?:the\s+)?(?:professor|lecturer|speaker|narrator|teacher|instructor|presenter|host|he|she|they|someone)\s+"
    r"(?:explains?|talks?\s+about|mentions?|says?|discuss(?:es)?|describes?|covers?|introduces?|defines?|goes\s+over)\s+"
)
SPLIT = (
    r"\s+(?:while|when|as|and)\s+(?:(?:he|she|they|it)\s+)?(?:showing|displaying|presenting|there\s+is|there's|"
    r"the\s+(?:slide|screen|diagram|chart|graph|video|camera)\s+(?:shows?|displays?|has|is|reads?|says?))\s+"
)
VISUAL_CUES = (
    r"\b(?:showing|shows|displayed|on\s+screen|on\s+the\s+screen|slide|diagram|chart|graph|whiteboard|"
    r"someone\s+(?:holding|wearing|carrying|riding|playing)|person|people|wearing|holding|scene|footage|"
    r"camera|visible|picture|image|looks\s+like|appears|color|red|blue|green|yellow|black|white|"
    r"umbrella|car|dog|cat|ball|basketball|court|crowd|building|street|screenshot|code|terminal)\b"
)
OCR_CUES = (
    r"\b(?:slide\s+(?:says|reads|titled|title)|title|caption|text\s+(?:says|reads)|written|reads|labell?ed|"
    r"the\s+words?|heading|bullet|code|terminal|screenshot|equation|formula)\b"
)
QUOTED = r'"([^"]{2,})"'
LEADING_ARTICLE = r"^\s*(?:the|a|an)\s+"
TERM = r"[a-z0-9][a-z0-9+#.'-]*"
QUERY_STOP_WORDS = (
    "the a an of to in on at for and or is are was were be it its this that these those with about from by "
    "as into there where when which what who how some someone something video clip moment part scene find "
    "show me all any does do did has have"
).split()

# --- fixed values: keyphrase candidates -----------------------------------------------------

PHRASE_TOKEN = r"[a-z][a-z0-9+#'-]*"
PHRASE_STOP_WORDS = (
    "a an the and or but if of to in on at for with about from by as into than then so is are was were be "
    "been being have has had do does did will would can could should may might must this that these those "
    "it its we you they he she i me my our your their them his her us what which who whom whose where when "
    "why how all any both each few more most other some such no nor not only own same too very just also "
    "let us now here there very really okay ok right yeah um uh like get got going go one two three want "
    "thing things way kind sort lot bit talk talking say said see look going"
).split()
TITLE_SMALL_WORDS = ("and", "of", "the", "in", "for")
CAPTION_ARTIFACTS = r"\b(arafed|araffe|arafes)\b\s*"

# --- fixed values: proposal review ----------------------------------------------------------

EDIT_PREFIX = r"^\[edit\]\s*"
GENERIC_VISUAL = "describe what is shown on screen"
OCR_FRAGMENT = r"(?:on-screen text mentions|while showing)\s+(.*)$"

# --- fixed values: search defaults ----------------------------------------------------------

LANES = ("text", "lexical", "visual", "ocr", "caption", "temporal")
LANE_WEIGHTS = {"text": 1.0, "lexical": 0.8, "visual": 0.8, "ocr": 0.6, "caption": 0.0, "temporal": 0.0}
FINAL_MIX = {"rerank": 0.5, "fused": 0.3, "visual": 0.2}
CUES = ("split", "speech", "visual", "ocr", "exact")
PASSAGE_CHARS = 1500
SNIPPET_CHARS = 320

# --- fixed values: metrics ------------------------------------------------------------------

RANK_CUTS = (1, 5, 10)
IOU_THRESHOLDS = (0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95)
TOLERANCE_S = 3.0

# --- fixed values: histogram bounds (seconds) -----------------------------------------------

JOB_BOUNDS = (1, 2, 5, 10, 20, 30, 60, 120, 300, 600)
INFERENCE_BOUNDS = (0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1, 2.5, 5, 10, 30, 60)
FIRST_SEARCHABLE_BOUNDS = (5, 10, 20, 30, 60, 120, 300, 600)
INDEX_WALL_BOUNDS = (30, 60, 120, 300, 600, 1200, 1800, 3600)
SEARCH_BOUNDS = (0.01, 0.025, 0.05, 0.1, 0.2, 0.3, 0.5, 0.75, 1, 2, 5)

# --- fixed values: timeline -----------------------------------------------------------------

MIN_TOPIC_S = 45.0
MAX_TOPICS = 24
FORCED_MIN_S = 10.0
SIMILARITY_ROWS = 3
