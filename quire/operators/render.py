"""A page's header, footer and title page as text, placed on a screen by cells."""

from __future__ import annotations

from datetime import datetime

from quire.functions.width import text_width, truncate_text

ORNAMENT = "─── ✦ ───"
ORNAMENT_WIDTH = text_width(ORNAMENT)
#: Rows that a title takes at most, and bytes of each.
TITLE_ROWS, TITLE_BYTES = 4, 510


def placed(parts: list[tuple[int, str]]) -> str:
    """Texts at their cells, each after the ones before; what is there is written over."""
    out: list[str] = []
    for at, text in parts:
        cells = "".join(out)
        head, used = "", 0
        for c in cells:
            if used + text_width(c) > at:
                break
            head, used = head + c, used + text_width(c)
        out = [head, " " * (at - used), text]
    return "".join(out)


def header(book: str, section: str, column: int, margin: int, title_page: bool = False) -> str:
    """The book's title on the left and the section's on the right, each cut to half of the column; the right one goes where there is room, and not on a title page."""
    half = max(10, (column - 4) // 2)
    left, right = truncate_text(book, half), truncate_text(section, half)
    at = margin + column - text_width(right)
    shown = right and not title_page and at > margin + text_width(left) + 2
    return placed([(margin, left), *([(at, right)] if shown else [])]).rstrip()


def footer(page: int, total: int, marked: bool, match: tuple[int, int] | None, clock: str, column: int, margin: int, wide: int) -> str:
    """Bookmark, arrows and page on the left, the match or the progress in the middle, the time on the right."""
    left = f"{'★ ' if marked else ''}{'←' if page > 1 else ' '} Pag. {page}/{total} {'→' if page < total else ' '}"
    middle = f"[Match {match[0]} of {match[1]}]" if match else f"[ {page * 100 // max(1, total)}% ]"
    at = (wide - text_width(middle)) // 2
    parts = [(margin, left)]
    if match or at > margin + text_width(left) + 2:
        parts.append((max(0, at), middle))
    if clock and column > text_width(clock):
        parts.append((margin + column - text_width(clock), clock))
    return placed(parts).rstrip()


def clock_text(now: datetime) -> str:
    """As 2:34am."""
    return f"{now.hour % 12 or 12}:{now.minute:02d}{'am' if now.hour < 12 else 'pm'}"


def title_rows(title: str, most: int) -> list[str]:
    """The title's words in as few rows as TITLE_BYTES allows."""
    rows: list[str] = []
    for word in title.replace("\t", " ").split(" "):
        if not word:
            continue
        if rows and len(f"{rows[-1]} {word}".encode()) <= TITLE_BYTES:
            rows[-1] += f" {word}"
        else:
            rows.append(word.encode()[:TITLE_BYTES].decode("utf-8", "ignore"))
    return rows[:most]


def title_page(title: str, column: int, margin: int, high: int) -> list[tuple[int, str]]:
    """(row, text): the title centred in the upper third of the body, and the ornament below it."""
    body = high - 4
    rows = title_rows(title, max(1, min(body - 2, TITLE_ROWS))) if body >= 1 else []
    if not rows:
        return []
    top = 2 + (body - min(len(rows) + 2, body)) // 3
    centred = lambda text: " " * (margin + max(0, (column - text_width(text)) // 2)) + text
    out = [(top + i, centred(r)) for i, r in enumerate(rows) if top + i < high - 2]
    if top + len(rows) + 1 < high - 2:
        out.append((top + len(rows) + 1, centred(ORNAMENT)))
    return out
