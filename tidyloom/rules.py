"""The cleaning rule document as frozen dataclasses.

``CleaningRules.parse`` accepts the JSON text or the parsed mapping. A missing
key, or a value of the wrong type, takes the default of its field; every rule is
off by default, so ``{}`` is the identity.
"""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import dataclass, field, fields, is_dataclass
from typing import Any


@dataclass(frozen=True)
class RemoveEmptyRows:
    enabled: bool = False
    condition: str = "all"
    columns_mode: str = "all"
    columns: tuple[str, ...] = ()


@dataclass(frozen=True)
class FillDefault:
    enabled: bool = False
    columns: tuple[str, ...] = ()
    values: Mapping[str, str] = field(default_factory=dict)
    only_when_empty: bool = True


@dataclass(frozen=True)
class FillForwardBackward:
    enabled: bool = False
    columns: tuple[str, ...] = ()
    directions: Mapping[str, str] = field(default_factory=dict)
    limit: int | None = None


@dataclass(frozen=True)
class Missing:
    trim_whitespace_for_empty_check: bool = True
    remove_empty_rows: RemoveEmptyRows = RemoveEmptyRows()
    fill_default: FillDefault = FillDefault()
    fill_forward_backward: FillForwardBackward = FillForwardBackward()


@dataclass(frozen=True)
class Dedup:
    enabled: bool = False
    mode: str = "wholeRow"
    columns: tuple[str, ...] = ()
    keep: str = "first"
    normalize_text: bool = False


@dataclass(frozen=True)
class DateFormat:
    enabled: bool = False
    columns: tuple[str, ...] = ()
    output_format: str = "YYYY-MM-DD"
    timezone: str = "local"
    on_invalid: str = "keep"


@dataclass(frozen=True)
class CurrencyFormat:
    enabled: bool = False
    columns: tuple[str, ...] = ()
    symbol: str = "¥"
    decimal_places: int = 2
    thousands_separator: bool = True


@dataclass(frozen=True)
class PhoneFormat:
    enabled: bool = False
    columns: tuple[str, ...] = ()
    country_code: str = ""
    output: str = "digits"


@dataclass(frozen=True)
class EmailFormat:
    enabled: bool = False
    columns: tuple[str, ...] = ()
    lowercase: bool = True
    trim: bool = True


@dataclass(frozen=True)
class TextFormat:
    enabled: bool = False
    columns_mode: str = "allText"
    columns: tuple[str, ...] = ()
    trim: bool = False
    collapse_spaces: bool = False
    remove_all_whitespace: bool = False


@dataclass(frozen=True)
class Format:
    date: DateFormat = DateFormat()
    currency: CurrencyFormat = CurrencyFormat()
    phone: PhoneFormat = PhoneFormat()
    email: EmailFormat = EmailFormat()
    text: TextFormat = TextFormat()


@dataclass(frozen=True)
class RemoveEmptyCols:
    enabled: bool = False
    condition: str = "all"


@dataclass(frozen=True)
class Rename:
    enabled: bool = False
    mappings: tuple[Mapping[str, str], ...] = ()


@dataclass(frozen=True)
class Drop:
    enabled: bool = False
    columns: tuple[str, ...] = ()


@dataclass(frozen=True)
class Split:
    enabled: bool = False
    column: str = ""
    separator: str = ""
    into: tuple[str, ...] = ()
    keep_original: bool = True


@dataclass(frozen=True)
class Merge:
    enabled: bool = False
    columns: tuple[str, ...] = ()
    separator: str = ""
    into: str = ""
    drop_sources: bool = False


@dataclass(frozen=True)
class Columns:
    remove_empty_cols: RemoveEmptyCols = RemoveEmptyCols()
    rename: Rename = Rename()
    drop: Drop = Drop()
    split: Split = Split()
    merge: Merge = Merge()


@dataclass(frozen=True)
class CleaningRules:
    missing: Missing = Missing()
    dedup: Dedup = Dedup()
    format: Format = Format()
    columns: Columns = Columns()

    @staticmethod
    def parse(document: str | Mapping[str, Any] | CleaningRules) -> CleaningRules:
        if isinstance(document, CleaningRules):
            return document
        if isinstance(document, str):
            document = json.loads(document)
        if not isinstance(document, Mapping):
            raise ValueError("a rule document must be a JSON object")
        rules = _read(CleaningRules(), document)
        limit = rules.missing.fill_forward_backward.limit
        if limit is not None and limit < 0:
            raise ValueError("fillForwardBackward.limit must not be negative")
        return rules

    def to_document(self) -> dict[str, Any]:
        return _write(self)

    @property
    def needs_order(self) -> bool:
        """Whether the result depends on the order of the rows."""
        dedup = self.dedup.enabled and self.dedup.keep in ("first", "last")
        return dedup or self.missing.fill_forward_backward.enabled

    @property
    def row_local(self) -> bool:
        """Whether every enabled rule looks at one row at a time."""
        return not (
            self.dedup.enabled
            or self.missing.fill_forward_backward.enabled
            or self.columns.remove_empty_cols.enabled
        )


def default_document() -> dict[str, Any]:
    """The template a new table starts from: every rule off, usual options set."""
    document = _write(CleaningRules())
    document["dedup"]["normalizeText"] = True
    document["format"]["text"]["trim"] = True
    return document


def _json_key(name: str) -> str:
    head, *rest = name.split("_")
    return head + "".join(word.capitalize() for word in rest)


def _read(default: Any, given: Any) -> Any:
    """``default`` with the keys of ``given`` that have the right type."""
    given = given if isinstance(given, Mapping) else {}
    values = {}
    for f in fields(default):
        have = getattr(default, f.name)
        value = given.get(_json_key(f.name))
        if is_dataclass(have):
            values[f.name] = _read(have, value)
        else:
            values[f.name] = _typed(f.name, have, value)
    return type(default)(**values)


def _typed(name: str, default: Any, value: Any) -> Any:
    if name == "limit":
        return value if isinstance(value, int) and not isinstance(value, bool) else None
    if name == "mappings":
        pairs = value if isinstance(value, list) else []
        return tuple(
            {k: p[k] if isinstance(p.get(k), str) else "" for k in ("from", "to")}
            for p in pairs
            if isinstance(p, Mapping)
        )
    if isinstance(default, bool):
        return value if isinstance(value, bool) else default
    if isinstance(default, int):
        good = isinstance(value, int) and not isinstance(value, bool) and value >= 0
        return value if good else default
    if isinstance(default, tuple):
        listed = value if isinstance(value, list | tuple) else []
        return tuple(v for v in listed if isinstance(v, str))
    if isinstance(default, Mapping):
        held = value if isinstance(value, Mapping) else {}
        return {k: v for k, v in held.items() if isinstance(v, str)}
    return value if isinstance(value, str) else default


def _write(rules: Any) -> dict[str, Any]:
    document = {}
    for f in fields(rules):
        value = getattr(rules, f.name)
        if is_dataclass(value):
            value = _write(value)
        elif isinstance(value, tuple):
            value = [dict(v) if isinstance(v, Mapping) else v for v in value]
        elif isinstance(value, Mapping):
            value = dict(value)
        document[_json_key(f.name)] = value
    return document
