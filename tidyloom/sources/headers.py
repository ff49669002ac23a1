"""Header repair."""

from __future__ import annotations

from collections.abc import Sequence

from tidyloom.functions.whitespace import WHITE_SPACE

# Names given to blank headers, by style.
BLANK_NAMES = {"native": "Unnamed_{}", "web": "列{}"}


def normalize_headers(names: Sequence[str | None], style: str = "native") -> list[str]:
    """A name for each column: blank ones numbered, repeated ones made unique.

    ``native`` appends ``_1``, ``_2``, ... until the name is unused; ``web`` counts
    the occurrences of a name and appends that, from ``_2`` on.
    """
    blank = BLANK_NAMES[style]
    result: list[str] = []
    seen: dict[str, int] = {}
    for i, name in enumerate(names, start=1):
        base = name if name and name.strip(WHITE_SPACE) else blank.format(i)
        unique = base
        if style == "native":
            suffix = 0
            while unique in seen:
                suffix += 1
                unique = f"{base}_{suffix}"
            seen[unique] = 1
        else:
            seen[base] = seen.get(base, 0) + 1
            if seen[base] > 1:
                unique = f"{base}_{seen[base]}"
        result.append(unique)
    return result
