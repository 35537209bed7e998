"""Formats that prompts, answers and files must follow exactly."""

from __future__ import annotations

# Fixed values of the text layouts.
MISSING = "nan"
NO_METADATA = "None"
NO_TYPES = "None"
EMPTY_TYPES = "[]"
NO_ENTITY = "0"
NIL_GOLD = "0"
PIPE_HEADER = "ID | NAME | DESCRIPTION | TYPE"

# Fixed values of the answers.
ANSWER_MARKER = "### Answer:"
NO_MARKER = "Marker not found in the string."

# Fixed values of the retrieval service.
NO_RESULT = "No good Wikidata Search Result was found"
RESULT_PATTERN = "Result Q[0-9]+:\nLabel:"

# Fixed values of the fine-tuning preparation.
MAX_TOKENS = 2875
HISTOGRAM_BINS = 20
LIST_LIMIT = 20

# Text that stands for a missing cell when table files are read, as the
# CSV reader of pandas defines it.
NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
)

# The characters that Python's str.strip and str.split treat as white space.
WHITESPACE = "".join(chr(code) for code in range(0x3001) if chr(code).isspace())
