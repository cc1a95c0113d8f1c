"""Patterns that decide how a line of a paper is read.

Fixed values: results depend on exactly these. Written so that Java's, Python's
and (where no lookaround is used) DuckDB's engines read them alike.
"""

QNO_HEADER = r"(?i)^\s*Q\s*\.?\s*N\s*O\s*\.?\b"
PAGE_FOOTER = r"(?i)^\s*Page\s+\d+\s*(?:/|\bof\b)\s*\d+\b"
SECTION = r"^\s*(?i:Section|Part|Unit)\s*[-–—:]?\s*([A-Z]{1,2}|[IVXLC]{1,5}|\d{1,3})(?:\s*[—–\-:|]\s*(.+?))?\s*$"
ATTEMPT_START = r"(?i)^\s*(?:Attempt|Answer)\b"
ATTEMPT_OPENING = r"(?i)^[\s\u00a0]*(?:Attempt|Answer)"
ATTEMPT_SHAPE = r"(?i)\ball\s+\d+\s+questions?\b|\b\d+\s*out\s*of\s*\d+\b|\bcarries?\s+\d+\s*marks?\b|\bany\s+\d+\s+questions?\b"
INSTRUCTIONS_HEADING = r"(?i)^\s*(?:(?:general\s+)?instructions?|notes?)\s*:\s*$|^\s*(?:general\s+)?instructions?\s*$"
DECLARED_ALL = r"(?i)^\s*(?:Attempt|Answer)\b.*?\ball\b\s+(\d+)\s*questions?"
DECLARED_PICK = r"(?i)^\s*(?:Attempt|Answer)\b.*?\b(\d+)\s*out\s*of\s+\d+"
CARRIED_MARKS = r"(?i)\bcarries?\s+(\d{1,3})\s*mark"
CHAPTER_TAG = r"(?i)^\s*\[Ch\s*\d+\s*:.*\]\s*$"
QUESTION_START = r"^\s*(?:Q\s*\.?\s*)?(\d{1,3})\s*([.)])?\s+(\S.*)$"
BARE_NUMBER = r"^\s*(?:Q\s*\.?\s*)?\d{1,3}\s*$"
PLAIN_NUMBER = r"^\s*(\d{1,3})\s*$"
OPTION_MARK = r"\(([A-H])\)\s*"
SUBPART = r"^\s*\((?:[A-Za-z]{1,4}|[ivx]{1,4})\)\s+\S"
OR_SEPARATOR = r"(?i)^\s*OR\s*$"
TRAILING_MARKS = r"^(.*[.?!…।])\s+(\d{1,3})$"
SENTENCE_END = r"[.?!…।]\s*$"
FIGURE_REF = r"(?i)\b(?:fig(?:ure)?\.?|diagram|graph|plot|sketch)\s*(?:\d+|(?:below|above|here|shown|given|accompanying|adjacent|opposite)\b)|\b(?:see|shown in|as shown in|refer to)\s+(?:the\s+|given\s+)?(?:fig(?:ure)?\.?|diagram|graph|plot)\b"
FIGURE_BELOW = r"(?i)\bbelow\s+(?:is|are)\s+the\s+(?:fig(?:ure)?|diagram|graph)\b"
NUMERICAL_HINTS = r"(?i)\b(calculate|compute|find|evaluate|determine|obtain|derive|prove|show that|verify|how many|how much|number of|value of|distance|area|perimeter|volume|height|width|length|cost|fare|rate|probability|equation|sum of|product of|simplify|factorise|expand)\b"
CASE_STUDY = r"(?i)\bcase\s+(?:study|based)\b"
UNIT_LEAD = r"(?i)^\s*(?:\d|[.°%]|(?:degrees?|radians?|kg|kgs?|gm|grams?|cm|mm|km|ml|l\b|litres?|liters?|marks?|points?|units?|years?|days?|hours?|minutes?|seconds?|months?|rupees?|rs\.?|₹|\$|%|times|sq\.?|feet|foot|inch(?:es)?|metres?|meters?)\b)"
SUBJECT = r"(?i)Subject\s*:\s*([^|]+)"
CLASS = r"(?i)\bClass\s*:\s*([^|]+)"
TOTAL_MARKS = r"(?i)Total\s+Marks\s*:\s*(\d+)"
BOARD_TAIL = r"\|\s*([A-Z][A-Za-z. ]{1,20})\s*$"
TIME_ALLOWED = r"(?i)Time\s+Allowed\s*:\s*([^|]+)"
QUESTION_LABEL = r"^(?:q(?:uestion)?\s*\.?\s*\d+\s*[:\.\-\)]|\d+\s*[:\.\-\)])\s*"

MAX_HEADING, MAX_MARKS, MAX_OPTION_SCAN, BAND, RUNNING_HEAD = 90, 100, 15, 3, 60
HARD_WORDS = ("prove", "derive", "justify", "evaluate", "hence")
TYPES = ("numerical", "mcq", "short", "long")
VISION_TYPES = {"mcq": "mcq", "numerical": "numerical", "short_answer": "short", "descriptive": "long", "coding": "long", "fill_in_the_blank": "short", "true_false": "short", "unknown": "short"}
