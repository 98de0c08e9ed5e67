"""Quick units of a text for scoring: sentences in prose, lines in lists and tables.

Scores need stable units, not exact boundaries; those are in ``sentences``.
"""

from __future__ import annotations

import re

_PARAGRAPH = re.compile(r"\n\s*\n")
# It begins with one character of a class, so that the search skips all others.
_STOP = re.compile(r"[.!?…。！？](?:[.!?…。！？]*[\"'”’»)\]]*(?=\s|$)|(?<=[。！？]))")


def units(text: str) -> list[str]:
    """Sentences of each paragraph; lines where a paragraph has fewer sentence marks than half its lines."""
    out = []
    for part in _PARAGRAPH.split(text.replace("\r\n", "\n").replace("\r", "\n")):
        lines = [x for x in part.split("\n") if x.strip()]
        if not lines:
            continue
        ends = [m.end() for m in _STOP.finditer(part)]
        if len(lines) > 1 and 2 * len(ends) < len(lines):
            out += lines
            continue
        at = 0
        for e in [*ends, len(part)]:
            piece = part[at:e].strip()
            if piece:
                out.append(piece)
            at = e
    return out
