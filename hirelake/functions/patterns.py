"""What patterns mean by words and white space."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A word's border where words are of ASCII letters, digits and underscores, which is what the patterns mean by ``\\b``; Java's own knows all letters.
BORDER = r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))"
NO_BREAK_SPACE = "\u00a0"


def ascii_borders(pattern: str) -> str:
    """``pattern`` with ASCII borders: one look is enough beside a letter or digit that has to be there."""

    def border(m: re.Match) -> str:
        if re.match(r"[A-Za-z0-9](?![?*{])", pattern[m.end() :]):
            return r"(?<!\w)"
        if re.search(r"(?<!\\)[A-Za-z0-9]$", pattern[: m.start()]):
            return r"(?!\w)"
        return BORDER

    return re.sub(r"\\b", border, pattern)


def plain_spaces(text: Column) -> Column:
    return F.translate(text, NO_BREAK_SPACE, " ")
