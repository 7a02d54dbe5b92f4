"""Paths inside a book, for the reader of archives; the same rules as the column expressions in functions.text."""

from __future__ import annotations

import re

ESCAPE = re.compile(rb"%([0-9A-Fa-f]{2})")


def normalize(path: str) -> str:
    done: list[str] = []
    for part in path.split("/"):
        if part == "..":
            del done[-1:]
        elif part not in ("", "."):
            done.append(part)
    return ("/" if path.startswith("/") else "") + "/".join(done)


def join(base: str, rel: str) -> str:
    if rel.startswith("/") or not base:
        return normalize(rel)
    return normalize(f"{base}/{rel}" if rel else base)


def dirname(path: str) -> str:
    return path.rpartition("/")[0]


def decode(url: str) -> str:
    return ESCAPE.sub(lambda m: bytes([int(m[1], 16)]), url.replace("+", " ").encode()).decode("utf-8", "replace")
