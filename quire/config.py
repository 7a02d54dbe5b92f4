"""Thresholds and other fixed values of the pipeline, and the options of a run."""

from __future__ import annotations

from dataclasses import dataclass

# Fixed values.
HEADING_MAX_WORDS = 20
HEADING_MIN_RATIO = 1.10
TITLE_RATIO = 1.30
RUNNING_HEAD_MIN_REPEATS = 4
RUNNING_HEAD_MIN_BYTES = 8
RUNNING_HEAD_MAX_WORDS = 16
FOLIO_MIN_EVIDENCE = 4
FOLIO_MIN_PARAGRAPH_WORDS = 8
PAGE_NUMBER_MAX_DIGITS = 4
RATIO_LEAST, RATIO_MOST = 0.2, 5.0
CSS_BASE_PX = 16.0
CSS_KEY_MAX = 128
TITLE_REPEAT_MAX_WORDS = 12
TITLE_MAX_BYTES = 255
WORD_MAX_BYTES = 4095
MAX_BOOKMARKS = 256
COLUMN_WIDTHS = (0, 50, 60, 66, 76, 86)
AUTO_COLUMN, MIN_PAGE_HEIGHT = 66, 4
ANCHOR_PREFIX = "quire-h"
BOLD, ITALIC, UNDERLINE, CODE, DIM, HEADING = 1, 2, 4, 8, 16, 32
#: Titles that only navigate.
JUNK_TITLES = (
    "(torna all'indice)",
    "torna all'indice",
    "torna all’ indice",
    "torner",
    "indice",
    "indice generale",
    "index",
    "contents",
    "table of contents",
    "sommario",
    "indietro",
    "back",
    "<-",
    "←",
)
#: Font size keywords and their ratios to the base size.
SIZE_KEYWORDS = {
    "xx-small": 0.60,
    "x-small": 0.75,
    "small": 0.89,
    "medium": 1.00,
    "large": 1.20,
    "x-large": 1.50,
    "xx-large": 2.00,
    "xxx-large": 3.00,
    "larger": 1.20,
    "smaller": 0.83,
}
#: What one unit is of the base size.
SIZE_UNITS = {
    "": 1.0,
    "em": 1.0,
    "rem": 1.0,
    "%": 1 / 100.0,
    "px": 1 / 16.0,
    "pt": 1 / 12.0,
    "pc": 1.0,
    "in": 96.0 / 16.0,
    "cm": 96.0 / 2.54 / 16.0,
    "mm": 96.0 / 25.4 / 16.0,
    "ex": 0.5,
    "ch": 0.5,
    "vw": 1 / 100.0,
    "vh": 1 / 100.0,
}


@dataclass(frozen=True)
class Options:
    """mode: 'intent' follows what the format is meant to do, 'strict' reproduces known oddities of older readers.

    synthesize_over_fallback: whether a table of contents that is only the numbered fallback may be replaced by one
    from headings (None: as the mode has it). order_by_spine: sorts a merged table of contents by chapter.
    unicode_norm: keeps letters beyond ASCII in what running heads are compared by.
    """

    mode: str = "intent"
    column_width: int = 66
    page_height: int = 24
    full_justify: bool = True
    paragraph_style: int = 0
    synthesize_over_fallback: bool | None = None
    order_by_spine: bool = False
    unicode_norm: bool = False

    @property
    def strict(self) -> bool:
        return self.mode == "strict"

    @property
    def replaces_fallback(self) -> bool:
        return not self.strict if self.synthesize_over_fallback is None else self.synthesize_over_fallback
