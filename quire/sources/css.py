"""Style sheets to rows of declarations. Only the tokenizer is Python; what declarations mean is in operators.cascade."""

from __future__ import annotations

import re
from collections.abc import Iterator

SKIP = re.compile(r"\s+|/\*.*?(?:\*/|\Z)", re.S)
STRING = re.compile(r"\"(?:\\.|[^\"\\])*(?:\"|\Z)|'(?:\\.|[^'\\])*(?:'|\Z)", re.S)
COMMENT = re.compile(r"/\*.*?(?:\*/|\Z)", re.S)


def _scan(text: str, at: int, stop: str) -> int:
    """The place of the first character of `stop` outside strings, comments and nested brackets; the end if there is none."""
    depth = 0
    while at < len(text):
        c = text[at]
        if c in "\"'" and (m := STRING.match(text, at)):
            at = m.end()
            continue
        if c == "/" and (m := COMMENT.match(text, at)):
            at = m.end()
            continue
        if c == "\\":
            at += 2
            continue
        if not depth and c in stop:
            return at
        if c in "([{":
            depth += 1
        elif c in ")]}" and depth:
            depth -= 1
        at += 1
    return len(text)


def split_outside(text: str, sign: str) -> list[str]:
    """text cut at a sign where it stands outside strings, comments and brackets."""
    parts, at = [], 0
    while at <= len(text):
        end = _scan(text, at, sign)
        parts.append(text[at:end])
        at = end + 1
    return parts


def declarations(body: str, strict: bool = False) -> Iterator[tuple[str, str]]:
    """(property, value) of a rule's body. Comments are blanks, but strict keeps one that stands before a property."""
    for part in split_outside(body, ";"):
        part = part if strict else COMMENT.sub(" ", part)
        name, colon, value = part.partition(":")
        if colon and name.strip() and value.strip():
            yield name.strip(), COMMENT.sub(" ", value).strip()


def rules(sheet: str, strict: bool = False) -> Iterator[tuple[list[str], list[tuple[str, str]]]]:
    """(selectors, declarations) in order. @media and @supports are entered whatever they ask for, other at-rules passed over."""
    at = 0
    while at < len(sheet):
        if m := SKIP.match(sheet, at):
            at = m.end()
            continue
        if sheet.startswith(("<!--", "-->"), at):
            at += 4 if sheet[at] == "<" else 3
            continue
        if sheet[at] == "}":
            at += 1
            continue
        start, brace = at, _scan(sheet, at, "{;" if sheet[at] == "@" else "{}")
        if brace >= len(sheet) or sheet[brace] in ";}":
            at = brace + 1
            continue
        end = _scan(sheet, brace + 1, "}")
        head, body = COMMENT.sub(" ", sheet[start:brace]).strip(), sheet[brace + 1 : end]
        if head.startswith("@"):
            if re.match(r"@(media|supports)\b", head, re.I):
                yield from rules(body, strict)
        elif found := list(declarations(body, strict)):
            yield [s.strip() for s in split_outside(head, ",") if s.strip()], found
        at = end + 1


def rows(sheet: str, strict: bool = False) -> Iterator[tuple[list[str], str, str]]:
    """(selectors, property, value), a row for each declaration in order."""
    for selectors, found in rules(sheet, strict):
        for prop, value in found:
            yield selectors, prop, value


def size_ratio(value: str) -> float | None:
    """As functions.text.css_size, for style attributes met while parsing."""
    from quire import config as C

    if value in C.SIZE_KEYWORDS:
        return C.SIZE_KEYWORDS[value]
    m = re.fullmatch(r"([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)) *([a-z%]*)", value)
    if not m or m[2] not in C.SIZE_UNITS or (ratio := float(m[1]) * C.SIZE_UNITS[m[2]]) <= 0:
        return None
    return min(C.RATIO_MOST, max(C.RATIO_LEAST, ratio))


def effect(style: str, strict: bool = False) -> tuple[set[str], float | None]:
    """(flags, ratio) of a style attribute."""
    flags: set[str] = set()
    ratio = None
    for prop, value in declarations(style, strict):
        p, v = prop.lower(), value.lower()
        if not strict:
            v = re.sub(r"\s*!\s*important\s*$", "", v)
        if p == "font-weight" and (v in ("bold", "bolder") or (v.isdecimal() and int(v) >= 600)):
            flags.add("bold")
        elif p == "font-style" and v in ("italic", "oblique"):
            flags.add("italic")
        elif p in ("text-decoration", "text-decoration-line") and "underline" in v:
            flags.add("underline")
        elif p == "text-align" and v in ("center", "centre"):
            flags.add("center")
        elif p in ("page-break-before", "break-before") and v in ("always", "page", "left", "right", "recto", "verso"):
            flags.add("page_break_before")
        elif p == "font-size" and (r := size_ratio(v)) is not None:
            ratio = r
    return flags, ratio
