"""Predictions of changing shape: deep fields, ids and paths out of JSON, as Arrow UDFs.

JSON text without a fixed schema needs recursion, which column expressions do not have.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# The names that ids and ends of edges go by, in order of preference.
WRAPPERS = ("edges", "path", "events", "nodes")
SOURCES = ("source_event_id", "source", "from", "condition_event")
TARGETS = ("target_event_id", "target", "to", "effect_event")


def plain_id(x) -> str:
    if x is None:
        return ""
    return str(int(x)) if isinstance(x, float) and x.is_integer() else str(x).strip()


def _distinct(xs) -> list[str]:
    return [x for x in dict.fromkeys(map(plain_id, xs)) if x]


def _walk(data, at: str = ""):
    """(dotted path, value) of every field of nested objects, outer ones first; lists are values."""
    for k, v in data.items() if isinstance(data, dict) else ():
        here = f"{at}.{k}" if at else str(k)
        yield here, v
        yield from _walk(v, here)


def first_field(data, names: list[str]):
    """The field of the first name that is a whole path; if none is, of the first that ends one."""
    flat = dict(_walk(data))
    for n in names:
        if n in flat:
            return flat[n]
    return next((v for n in names for k, v in flat.items() if k.endswith(f".{n}")), None)


def ids_of(value, keys: list[str]) -> list[str]:
    """Ids in scalars, lists and objects; an object without an id of its own is searched in its lists only."""
    if isinstance(value, str | int | float):
        return [plain_id(value)]
    if isinstance(value, dict):
        own = next((value[k] for k in keys if value.get(k) is not None), None)
        return [plain_id(own)] if own is not None else _distinct(x for v in value.values() if isinstance(v, list) for x in ids_of(v, keys))
    return _distinct(x for v in value for x in ids_of(v, keys)) if isinstance(value, list) else []


def path_of(value) -> tuple[list[tuple[str, str]], list[str]]:
    """(edges, events) of an edge, a chain as text, a list of events, a list of edges or an object that holds one of these."""
    if isinstance(value, dict):
        pick = lambda names: next((value[n] for n in names if value.get(n)), None)
        if (inner := pick(WRAPPERS)) is not None:
            return path_of(inner)
        a, b = pick(SOURCES), pick(TARGETS)
        if a is not None and b is not None:
            return [(plain_id(a), plain_id(b))], [plain_id(a), plain_id(b)]
        own = pick(("event_id", "id"))
        return [], [plain_id(own)] if own is not None else []
    if isinstance(value, str):
        chain = [x for x in map(plain_id, re.split(r"->|→", value)) if x] if re.search("->|→", value) else None
        return ([], [plain_id(value)]) if chain is None else (list(zip(chain, chain[1:])), chain)
    if isinstance(value, list) and value:
        if all(isinstance(x, str | int | float) or isinstance(x, dict) and ("event_id" in x or "id" in x) for x in value):
            chain = [i for x in value if (i := plain_id((x.get("event_id") or x.get("id")) if isinstance(x, dict) else x))]
            return list(zip(chain, chain[1:])), chain
        parts = [path_of(x) for x in value]
        return [e for edges, _ in parts for e in edges], _distinct(x for _, events in parts for x in events)
    return [], []


def _parsed(x):
    try:
        return json.loads(x) if x else None
    except ValueError:
        return None


def field(json_text: Column, names: list[str]) -> Column:
    """The first of the named fields as JSON text, wherever it is."""

    def found(s: pd.Series) -> pd.Series:
        return pd.Series([None if (v := first_field(_parsed(x), names)) is None else json.dumps(v, ensure_ascii=False) for x in s], dtype=object)

    return F.pandas_udf(found, "string")(json_text)


def ids(json_text: Column, keys: list[str]) -> Column:
    def found(s: pd.Series) -> pd.Series:
        return pd.Series([ids_of(_parsed(x), keys) for x in s])

    return F.pandas_udf(found, "array<string>")(json_text)


def path(json_text: Column) -> Column:
    """struct<edges array<string> (as a>>b), events array<string>>."""

    def found(s: pd.Series) -> pd.DataFrame:
        rows = [path_of(_parsed(x)) for x in s]
        return pd.DataFrame({"edges": [[f"{a}>>{b}" for a, b in e] for e, _ in rows], "events": [v for _, v in rows]})

    return F.pandas_udf(found, "edges array<string>, events array<string>")(json_text)
