"""Fixed values that results depend on: word lists, patterns, presets, thresholds."""

# --- fixed values: stop words dropped from content tokens -------------------------------------------
STOP_WORDS = """
a an the and or but if then so of to in on at by for with from as is are was were be been being am i me my we our us
you your he she it they them his her its their this that these those there here what which who whom whose when where
why how not no yes do does did done have has had will would can could should may might must just very really also too
than about into over under up down out off again more most some any each other such only own same both few all let
lets lot lots like get got going go goes went gonna want need think know say said tell told hi hello everyone welcome
back channel today comments comment subscribe video guys thing things stuff one two
""".split()

# --- fixed values: short technical words kept as keywords -------------------------------------------
TECH_SHORT = """ai ml api apis web dev app apps ui ux vr ar sql css html gpu cpu seo iot llm cad gps""".split()

# --- fixed values: words that stock sites misread ---------------------------------------------------
BANNED_QUERY_WORDS = """screen background intro outro subscribe abstract concept futuristic hologram matrix wallpaper
template loop overlay""".split()

# --- fixed values: summary words that say nothing about the topic -----------------------------------
TOPIC_FILLER = """introduction intro brief video explains explaining showcasing showcase journey week long vibrant
filled known about overview guide tour speaker creator highlighting emphasizing discusses describes teaser vlog channel
viewers popular famous various different""".split()

# --- fixed values: roles a scored line may have -----------------------------------------------------
LINE_ROLES = ["hook", "key point", "example", "place", "data", "story", "transition", "aside", "cta"]
SPEAKER_ROLES = ["hook", "cta", "aside", "greeting"]

# --- fixed values: month names ----------------------------------------------------------------------
MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november",
          "december"]

# --- fixed values: claim patterns (English and Hindi) -----------------------------------------------
RECENT_EN = ("today|tonight|this (?:morning|afternoon|evening|week|weekend|month)|yesterday|last night|right now|"
             "currently|just now|breaking|latest|these days|at the moment")
RECENT_HI = "आज|आजकल|अभी|इस हफ्ते|इस सप्ताह|इस महीने|ताज़ा|कल रात|बीती रात"
YEAR_CLAIM = r"(?i)(?:(?:in|during|since|from|of|year|circa|c\.|back in)\s+|^|[.!?]\s*|\()((?:19|20)\d{2})\b"
WEATHER_WORDS = [  # order matters: the first class that matches wins
    ("rain", "rain|raining|rainy|rainfall|downpour|drizzle|monsoon|flood|flooded|flooding|waterlogged|deluge|"
             "thunderstorm|cloudburst", "बारिश|बरसात|बाढ़|मानसून|भारी बारिश|जलभराव"),
    ("sunny", "sunny|sunshine|heatwave|heat wave|scorching|clear sky|bright day", "धूप|चिलचिलाती|लू"),
    ("fog", "fog|foggy|mist|misty|smog", "कोहरा|धुंध"),
    ("snow", "snow|snowfall|snowy|blizzard", "बर्फ|बर्फबारी"),
]
OPPOSITE_WEATHER = [("rain", "sunny"), ("sunny", "snow"), ("fog", "sunny")]   # symmetric
UNDECIDED_WEATHER = ["night", "cloudy", "indoor"]

# --- fixed values: line scoring patterns ------------------------------------------------------------
SPEAKER_PHRASE = ("hi|hello|hey|welcome|subscribe|comment|comments|like this video|thanks for watching|see you|"
                  "let me know|i think|i guess|you know|so yeah|anyway")
NUMBER_WORD = "one|two|three|four|five|ten|hundred|thousand|million|billion|percent"
DIRECT_ADDRESS = "i|i'm|i've|me|my|you|your|we|let's|subscribe|comment|like this video"

# --- fixed values: TRUE thresholds ------------------------------------------------------------------
RECENT_DAYS = 45
WEATHER_BAD, WEATHER_WARN, WEATHER_OK = 0.97, 0.80, 0.60
GPS_MAX_KM = 60.0
DELTA_OK_STRONG, DELTA_OK_OTHER, DELTA_WARN, DELTA_CAP = 0.030, 0.010, -0.010, 0.050

# --- fixed values: retrieval -------------------------------------------------------------------------
TOP_POOL, MIN_SCORE, GATE_DELTA = 500, 0.18, 0.04
DEDUPE_SIM, DEDUPE_WINDOW_S = 0.93, 10.0
CLUSTER_DIST, MMR_POOL, DEFAULT_K, DEFAULT_DIVERSITY = 0.35, 100, 24, 0.3
TAG_WEIGHT, TAG_POOL = 0.07, 300
SEARCH_PER_SOURCE, PLAN_PER_SOURCE, SIMILAR_PER_SOURCE = 4, 3, 2
NICHE_WEIGHT, INGEST_SIM, CONFIDENCE_FLOOR = 0.30, 0.97, 0.31

# --- fixed values: cuts ------------------------------------------------------------------------------
SIZE_RANK = {"aerial": 1, "wide": 1, "medium": 2, "close": 3, "detail": 4}
CUT_PART_WEIGHTS = {"jump": 2.0, "flip": 1.0, "exposure": 0.8, "colour": 0.5, "subject": 0.3, "same_size": 0.6,
                    "progress": -0.4, "continuity": -0.2}
CUT_WEIGHT, CUT_NORM, REPEAT_PENALTY, SOURCE_REPEAT_PENALTY = 0.25, 4.0, 1.0, 0.03
FLOW_MIN = 0.25

# --- fixed values: edit memory -----------------------------------------------------------------------
MEM_BONUS, NEG_PENALTY, STYLE_BONUS, MEM_MIN_SIM, MEM_NEIGHBOUR, STYLE_MIN_N = 0.04, 0.03, 0.02, 0.55, 0.88, 5

# --- fixed values: spot density presets --------------------------------------------------------------
DENSITY = {
    "light": {"floor": 0.62, "cover": 0.25, "gap": 3.0, "per_min": 4},
    "balanced": {"floor": 0.45, "cover": 0.40, "gap": 1.5, "per_min": 7},
    "rich": {"floor": 0.30, "cover": 0.55, "gap": 0.8, "per_min": 11},
}
HOOK_S, MIN_SLOT_S, MAX_SLOT_S, VISUAL_MIN, FILMABLE_MIN = 3.0, 1.5, 5.0, 0.4, 0.5

# --- fixed values: licences --------------------------------------------------------------------------
LICENCE_LABELS = {"own": "Your footage", "safe": "Free to use", "attribution": "Credit required",
                  "caution": "Share-alike", "restricted": "Non-commercial", "unknown": "Licence unknown"}
COMMERCIAL_CLASSES = ["own", "safe", "attribution"]
LICENCE_RULES = [  # tested in this order on lower(licence || ' ' || url)
    ("restricted", ["-nc", "noncommercial", "non-commercial", "-nd", "noderiv"]),
    ("safe", ["public domain", "publicdomain", "cc0", "zero/1.0", "mark/1.0", "pixabay"]),
    ("caution", ["-sa", "sharealike", "share-alike"]),
    ("attribution", ["cc by", "cc-by", "/licenses/by/"]),
]

# --- fixed values: files and exports -----------------------------------------------------------------
VIDEO_EXTS = ["mp4", "mov", "m4v", "avi", "mkv", "webm"]
CAPTION_WIDTH, CAPTION_MAX_S, EXPORT_FPS = 42, 6.0, 25

# Reasons of spots chosen so that no video stays bare.
GUARANTEED = "a video always gets B-roll: "
BEST_LINE = "best available line"

# --- fixed values: labels burnt into a picture that is older than claimed, or not of the event -------
FILE_LABEL = "FILE · "
STOCK_LABEL = "STOCK · not event footage"
