"""Changes of JSON objects held as text: members set and removed, all others kept as they are written."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_BLANK = " \t\r\n"
_READ = json.JSONDecoder().raw_decode


def members(text: str) -> list[tuple[str, str]] | None:
    """The (name, value) of each member of an object in its order, the value as it is written; None if it is no valid object."""
    try:
        if not isinstance(_READ(text.lstrip(_BLANK))[0], dict):
            return None
        at, out = _after(text, 0, "{"), []
        while text[(at := _skip(text, at))] != "}":
            name, at = _READ(text, _after(text, at, ",") if out else at)
            begin = _skip(text, _after(text, at, ":"))
            _, at = _READ(text, begin)
            out.append((name, text[begin:at]))
        return out if not text[at + 1 :].strip(_BLANK) else None
    except (ValueError, IndexError):
        return None


def _skip(text: str, at: int) -> int:
    while text[at] in _BLANK:
        at += 1
    return at


def _after(text: str, at: int, mark: str) -> int:
    at = _skip(text, at)
    if text[at] != mark:
        raise ValueError(f"{mark} expected")
    return _skip(text, at + 1)


def _object(own: list[tuple[str, str]]) -> str:
    return "{" + ",".join(f"{json.dumps(name, ensure_ascii=False)}:{value}" for name, value in own) + "}"


def json_remove(c: Column, *keys: str) -> Column:
    """The object without members, repeated ones too; null if it is not an object."""

    @F.pandas_udf(T.StringType())
    def removed(texts: pd.Series) -> pd.Series:
        found = (None if t is None else members(t) for t in texts)
        return pd.Series([None if own is None else _object([m for m in own if m[0] not in keys]) for own in found], dtype="object")

    return removed(c)


def json_set(c: Column, key: str, value: Column) -> Column:
    """The object with a member of any value, a null as JSON's; in the place of the member of that name if there is one, else last.

    Where a name is repeated its first place is taken and the others go. Null if it is not an object.
    """

    @F.pandas_udf(T.StringType())
    def changed(texts: pd.Series, values: pd.Series) -> pd.Series:
        out = []
        for text, new in zip(texts, values):
            own = None if text is None else members(text)
            if own is not None:
                raw = members(new)[0][1]
                at = next((i for i, m in enumerate(own) if m[0] == key), len(own))
                own = [*(m for m in own[:at] if m[0] != key), (key, raw), *(m for m in own[at:] if m[0] != key)]
            out.append(None if own is None else _object(own))
        return pd.Series(out, dtype="object")

    return changed(c, F.to_json(F.struct(value.alias("v")), {"ignoreNullFields": "false"}))
