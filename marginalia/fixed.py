"""Values that results depend on.

Everything below is a fixed value: word lists, status names, comment texts and
patterns that must be spelled exactly so for the results to come out right.
Patterns are written for Java regular expressions with the flags given where
they are used (see ``functions.text.py_regex``).
"""

# ---------------------------------------------------------------- statuses
# Fixed values.
APPROVED, REJECTED, NEEDS_CHANGE = "approved", "rejected", "needs_change"
STATUSES = (APPROVED, REJECTED, NEEDS_CHANGE)

# Column order of the three CSV exports.
FINAL_FIELDS = ("issue_id", "status", "comment")
DETAIL_FIELDS = (
    "issue_id", "status", "checker", "confidence", "field", "original", "proposed",
    "comment", "context_before", "context_after", "breadcrumb", "node_label", "node_link",
)
REVIEW_FIELDS = ("decision", "review_note", *DETAIL_FIELDS)

# Version numbers written into exports and hashed into fingerprints.
MEMORY_SCHEMA_VERSIONS = (1, 2, 3)
FINGERPRINT_VERSION = 1
NEAR_MATCH_THRESHOLD = 0.97
NEAR_MATCH_BAND = 0.005
AUTOMATIC_SOURCE = "automatic_pattern_learning"
HUMAN_SOURCE = "human_feedback"

# ------------------------------------------------------- default rulebook
# Spelling terms that are never misspellings.
PROTECTED_SPELLING_TERMS = """
alouds alt app apps arborist arccosine arctan autograded autoscored avg backcountry
ballparking bivariate boxplot boxplots bpm cafe centi cheerleading checkbox checkboxes
cheeseball cheeseballs circumcenters clownfish collinearity contextualized contextualizing
criss decontextualize decontextualized decontextualizing desmos dfrac dialogic djembe
dotplot drahm drahms emoji emojis equiv esport esports exponentials exponentiating
extremum faceup factorable fah freehanding fullscreen fundraise ggbm giga gon graphene
greenspace gridline gridlines gulab handspan handspans hoodie hoodies incenters
inclusivity inequivalent infographics ish jamun jamuns journaling juego kgs kwh labelings
lakeful landline lassi los madrasah mah mcg midhinge midrange milli monic moonrises mpg
meetup meetups nanogram nanograms nonintuitive nonverbally num olds overpredict
overpredicts paletas passholder pavers pdfs petri picogram picograms preimage preimages
quinteger quintegers rana rebar recombinations recomposition redistributions refamiliarize
refamiliarizes regroupings repurpose reselecting resize resized revoicing rideshare
rightarrow rostral sapo scaffolded scalings scatterplot sci screenshot screenshots
shortcutting sightlines smartphone smartphones socio sqrt sqrtx starburst starscapes
staycation storewide subregions subitize tbsp tbsps tech teks tera tetration texted
texting themself thm thon tilapia trailhead transversal transversals treehouse trendline
trendlines trimean trinomials tsp tsps uncheck unchecking underpredict unflawed
unintuitive ungridded unitless unpopped unruled unscaffolded vape vaping vimeo videography
walkathon woodshop yesses yessier yessy zipline ziplines zurls zygomatic
""".split()

# Words a one-edit typo may be corrected to without review.
SAFE_TYPO_TARGETS = "and from have that the this with".split()

# Fixed values: (checker, original, proposed, status, comment).
EXACT_RULES = (
    ("check_spelling", "unkown", "unknown", "approved",
     'Confirmed typo: replace "unkown" with "unknown".'),
    ("check_spelling", "floorplan", "floor plan", "approved",
     'Use the standard spelling "floor plan".'),
    ("check_spelling", "numberline", "number line", "approved",
     'Use the standard math term "number line".'),
    ("check_spelling", "calucations", "calculations", "approved",
     'Confirmed typo: replace "calucations" with "calculations".'),
    ("check_spelling", "quadrilaterials", "quadrilaterals", "approved",
     'Confirmed typo: replace "quadrilaterials" with "quadrilaterals".'),
    ("check_spelling", "addtion", "addition", "approved",
     'Confirmed typo: replace "addtion" with "addition".'),
    ("check_spelling", "represenation", "representation", "approved",
     'Confirmed typo: replace "represenation" with "representation".'),
    ("check_spelling", "divisibilty", "divisibility", "approved",
     'Confirmed typo: replace "divisibilty" with "divisibility".'),
)
RULES_VERSION = "2026.07.29.2"

# ------------------------------------------------- classification patterns
# Fixed values.
STANDARDS_CODE = (
    r"[A-Z]{1,4}-[A-Z]{2,5}(\.[A-Za-z0-9]+)+|\b\d{1,2}\.[A-Z]{1,3}(\.[A-Za-z0-9]+)*\b"
)
STANDARDS_CODE_PREFIX = r"[A-Z]{2,4}-[A-Z]{2,5}$"
MATH_LABEL = r"\b(?:Equation|Card|Function|Expression)\s+[A-Z]\s*$"
MATH_LABEL_AMBIGUOUS = r"\n\s*[A-Z]\s*$"
MATH_SUBJECT = (
    r"^\s*(?:is|are|represents|denotes)\s+(?:a|the|an)?\s*"
    r"(?:function|variable|constant|independent|dependent|coefficient|"
    r"exponent|ratio|rate|slope)"
)
ABBREVIATION_TAIL = (
    r"\b(?:mr|mrs|ms|dr|st|jr|sr|vs|etc|i\.e|e\.g|no|ave|blvd|approx|"
    r"dept|est|fig|vol|pp|pg|op|assn|inc|corp|ltd|cf)\.\s*$"
)
INITIALS_TAIL = r"(?:[A-Z]\.){2,4}\s*$"
LIST_MARKER_TAIL = r"(?:\(?\d+\)|\(?[a-zA-Z]\)|\d+\.)\s*$"
OPENING_QUOTE_TAIL = r"['\"\u2018\u201c]\s*$"

# Reasoning phrases that mark lowercase notation.
CAPITALIZATION_REJECT_PHRASES = (
    "doi", "et al", "www.", "domain name", "xmlns", "imaginary unit",
    "mathematical constant", "trigonometric function", "cosine function",
    "sine function", "tangent function", "euler", "sequence term", "sequence label",
    "conventionally lowercase", "function notation", "standard mathematical notation",
    "radians", "greek letter", "function name",
)
# Reasoning phrases that ask for a person.
CAPITALIZATION_FLAG_PHRASES = (
    "flagged for review", "flagging for review", "human review",
    "without additional context", "without further context", "without full context",
    "it is unclear", "is unclear whether", "uncertain whether", "not entirely clear",
    "risks changing meaning", "not definitively required", "not clear if",
    "not clear whether",
)

# ---------------------------------------------------- classification texts
# Fixed values.
COMMENTS = {
    "latex": "Bare LaTeX command name; keep the original math notation.",
    "repeated": "Repeated-letter placeholder or math shorthand, not a misspelling.",
    "jargon": "Appears to be a valid technical/specialized term (or jargon), not "
              "a misspelling \u2014 checker false positive; proposed replacement is a "
              "different, incorrect word.",
    "code_artifact": "Standards-code boundary artifact, not a misspelling "
                     "\u2014 checker false positive.",
    "protected": "Known EdTech/math jargon or abbreviation, not a misspelling \u2014 "
                 "checker false positive.",
    "no_confidence": "No confidence signal is available in this report. Confirm whether "
                     "this is a genuine typo and whether the proposed replacement is correct.",
    "bare_token": "Bare single-letter math or answer-label token; keep lowercase.",
    "math_subject": "Math variable or function name; keep lowercase.",
    "cell_sentence": "Sentence start inside a prose table cell; capitalize.",
    "cell_abbreviation": "Text follows an abbreviation inside a table cell; keep lowercase.",
    "cell_unclear": "Capitalization boundary inside a prose table cell needs context.",
    "cell_label": "First text in a curriculum table cell follows the "
                  "lowercase-label convention.",
    "text_sentence": "Sentence or list-item start; capitalize.",
    "text_abbreviation": "Text follows an abbreviation, not a sentence boundary; "
                         "keep lowercase.",
    "text_unclear": "Capitalization inside paragraph/list text needs context.",
    "quoted": "Start of quoted speech; capitalize.",
    "flattened": "Flattened body-value table/list label; keep lowercase.",
    "notation": "Math notation, constant, or citation convention is conventionally "
                "lowercase \u2014 checker false positive.",
    "ambiguous_case": "Ambiguous whether this is a title/sentence start or math notation. "
                      "Check the surrounding context.",
    "no_reasoning": "This report has no reasoning text. Check whether the letter starts a "
                    "sentence or is inline math notation.",
    "upstream": "Possible upstream numeric inconsistency. Verify against the full problem "
                "before deciding.",
    "math_misread": "Math checker misread or mis-evaluated the expression; the proposed "
                    "value is unreliable.",
    "official_title": 'Official title "Texas Essential Knowledge and Skills"; '
                      "capitalize Texas.",
    "common_noun": "Common noun or idiom, not a proper noun.",
    "trailing_off": "Sentence-frame trailing-off convention; do not collapse the ellipsis "
                    "to one period.",
    "double_period": "End-of-field double period may be a typo or deliberate trailing-off.",
    "punctuation": "Punctuation convention needs human judgment.",
    "code_boundary": "Standards code or math-expression boundary, not a missing-space error.",
    "answer_label": "Bare capital letter after a line break may be answer text or a math "
                    "label. Check what follows.",
    "spacing": "Spacing pattern needs human judgment.",
    "learned_term": "Valid curriculum or technical term.",
}

# ----------------------------------------------------- comment policy
# Phrases about the review workflow.
OPERATIONAL_PHRASES = (
    r"(?:ai|model|checker)?\s*confidence",
    r"human\s+(?:review|reviewer|judg(?:e)?ment|check|verification)",
    r"manual\s+(?:review|check|verification)",
    r"needs?\s+(?:a\s+)?human",
    r"flagged?\s+for\s+review",
    r"needs?\s+(?:further\s+)?review",
    r"ambiguous|unclear|uncertain",
    r"insufficient\s+context|not\s+enough\s+context",
    r"without\s+(?:additional|further|full)\s+context",
    r"no\s+(?:ai\s+)?reasoning",
    r"check\s+(?:the|whether|what|against)",
    r"verify\s+(?:the|whether|what|against)",
    r"confirm\s+whether",
    r"possible|may\s+be|could\s+be",
    r"unrecognized\s+checker",
)
# Phrases that carry a reusable reason.
CONCRETE_PHRASES = (
    r"false\s+positive",
    r"misspell(?:ing|ed)?|typo",
    r"jargon|abbreviation|technical\s+term|specialized\s+term",
    r"curriculum[-\s]specific\s+(?:term|word|name)",
    r"valid\s+(?:term|word|name|abbreviation|notation)",
    r"standards?[-\s]code|markup\s+boundary",
    r"math\s+checker",
    r"math(?:ematical)?\s+(?:notation|expression|label|constant|variable)",
    r"latex|mathml|equation|imaginary\s+unit|math\s+shorthand",
    r"repeated[-\s]letter|placeholder",
    r"citation\s+convention|doi|et\s+al",
    r"proper\s+noun|common\s+noun|idiom",
    r"missing[-\s]space|spacing\s+error",
    r"punctuation|ellipsis|period|comma|colon|semicolon",
    r"capitalization|capitalize|lowercase|uppercase",
    r"broken\s+link|url",
    r"original\s+(?:is|was)\s+correct",
    r"proposed\s+(?:change|replacement|value|word).*(?:wrong|incorrect|unreliable)",
    r"incorrect\s+(?:word|value|replacement)",
    r"wrong\s+(?:word|value|replacement)",
)
# Fixed values.
DIRECT_ACTION = (
    r"\b(?:replace|change|correct|fix|remove|add|insert|delete)\b|\bshould be\b"
)
CONDITIONAL_ACTION = r"\b(?:use|keep|retain)\b"
JUDGEMENT = r"\b(?:valid|correct|incorrect|wrong|preferred)\b"
QUOTED_TEXT = "[\"\u201c\u201d'`][^\"\u201c\u201d'`]+[\"\u201c\u201d'`]"
# Whole comments that say nothing.
VAGUE_PHRASES = (
    r"approved|rejected|reviewed",
    r"looks?\s+(?:correct|incorrect|fine|good)",
    r"(?:no\s+)?change\s+needed",
    r"no\s+changes?",
    r"(?:change|correction)\s+needed",
    r"confirmed\s+by\s+(?:a\s+)?human",
)
# Fixed values.
REVIEW_PREFIX = (
    r"^\s*(?:(?:human|manual)\s+review|reviewer|confirmed\s+by\s+(?:a\s+)?human)"
    r"(?:\s+(?:determined|confirmed|found))?(?:\s+that)?"
    "\\s*[:\\-\u2013\u2014]*\\s*"
)
CLAUSE_BREAK = "(?:\\.\\s+|;\\s*|\\s+(?:--|\u2014|\u2013)\\s+)"

# ------------------------------------------------------ matching patterns
# Fixed values.
URL_TEXT = r"https?://\S+"
UUID_TEXT = r"\b[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\b"
LOCATION_WORD = r"\b(?:unit|section|lesson|check|assessment|module)\b"
NEEDS_CHANGE_PREFIX = r"^\s*needs[\s_-]*change\s*[-,:]\s*(.*)$"
REVIEW_SUFFIX = r"_review(?:_detailed)?$"

# ------------------------------------------------- automation policy texts
# Fixed values.
AUTOMATION_REASONS = {
    "term": "Confirmed valid term recurring across courses.",
    "math": "Confirmed math-checker false positive.",
    "spacing": "Consistent spacing decision across reviewed courses.",
    "capitalization": "Consistent math or standards notation across reviewed courses.",
    "spelling": "Consistent spelling decision across reviewed courses.",
}
NOTATION_SIGNALS = ("math", "notation", "constant", "standard", "lowercase")
TERM_SUGGESTION, RULE_SUGGESTION = "protected spelling term", "exact rule"

# ------------------------------------------------------- tickets and runs
# Fixed values.
RUN_HOSTS = ("github.com", "www.github.com")
RUN_PATH = r"^/([^/]+)/([^/]+)/actions/runs/(\d+)(?:/.*)?$"
RUN_LINK = r"^https://(?:www\.)?github\.com/[^/]+/[^/]+/actions/runs/\d+"
HTTP_LINK = r"https?://[^\s<>\"]+"
HTML_MIME_TYPES = ("text/html", "application/xhtml+xml")
REPORT_MARKERS = ("issue-card", "aggregated-issue")
ARTIFACT_KEYWORDS = ("qa", "report", "annotat", "review")
MAX_ARTIFACT_BYTES = 400 * 1024 * 1024
MAX_REPORT_BYTES = 1200 * 1024 * 1024
