"""Scalar functions: casts by a default's type, parsing of flags, formatting of contexts."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Answers that count as true.
TRUE_WORDS = ("yes", "y", "true", "t", "1")


def discretize(cost: Column) -> Column:
    """A duration in seconds as one of four phrases."""
    return F.when(cost < 10, "under 10 seconds").when(cost < 100, "under 2 minutes").when(cost < 1000, "up to 15 minutes").otherwise("more than 15 minutes")


def to_bool(c: Column) -> Column:
    return F.lower(c).isin(*TRUE_WORDS)


def cast_like(text: str, default: Any) -> Any:
    """A command-line value in the type of its default; lists and tuples split into characters."""
    if isinstance(default, bool):
        return text.lower() in TRUE_WORDS
    for kind in (int, float, str, list, tuple):
        if isinstance(default, kind):
            return kind(text) if text or kind in (int, float) else kind()
    raise TypeError(f"a default of {type(default).__name__} has no cast")


def is_integer(c: Column) -> Column:
    return F.coalesce(c.rlike(r"^\s*[+-]?\d+(_\d+)*\s*$"), F.lit(False))


def is_json(c: Column) -> Column:
    return F.try_parse_json(c).isNotNull()


def jsonable(value: Any) -> bool:
    try:
        json.dumps(value)
    except (TypeError, OverflowError, ValueError):
        return False
    return True


def describe(path: Column, name: Column, value: Column) -> Column:
    """``epoch: 0, step: 500, loss: 0.1`` from a context path and a logged value."""
    steps = F.transform(F.coalesce(path, F.array()), lambda s: F.concat(s["name"], F.lit(": "), F.coalesce(s["value"], s["iteration"].cast("string"), F.lit("None"))))
    return F.array_join(F.concat(steps, F.array(F.concat(name, F.lit(": "), value))), ", ")


def checkpoint_name(path: Column, name: Column, extension: Column) -> Column:
    """``name_loop_value.ext``; separators inside the parts are percent-escaped, so names can't collide."""

    def safe(c: Column) -> Column:
        for raw, quoted in (("%", "%25"), ("_", "%5F"), ("/", "%2F"), (".", "%2E")):
            c = F.replace(c, F.lit(raw), F.lit(quoted))
        return c

    steps = F.transform(F.coalesce(path, F.array()), lambda s: F.concat(safe(s["name"]), F.lit("_"), safe(F.coalesce(s["value"], s["iteration"].cast("string"), F.lit("None")))))
    return F.concat(F.array_join(F.concat(F.array(safe(name)), steps), "_"), extension)


def parse_settings(c: Column) -> Column:
    """``key=value key=value`` as a map."""
    return F.str_to_map(c, F.lit(" "), F.lit("="))
