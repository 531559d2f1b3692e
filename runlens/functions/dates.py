"""Date functions over text times with constant modifiers, as Spark SQL.

A time is ISO text, a timestamp, or the number of a Julian day (of seconds, with
``'unixepoch'``); what is no time gives null.  Modifiers apply from left to right:
``'±n days'`` (hours, minutes, seconds, months, years), ``'±HH:MM'``, ``'start of day'``
(month, year), ``'weekday n'``, ``'unixepoch'``.  As there, a month later keeps the day's number
and runs over: January 31 and a month is March 2 or 3.  Times have no zone.
"""

from __future__ import annotations

import re

#: Per name, how the shifted time is shown.
NAMES = {
    "date": "substr(CAST({t} AS STRING), 1, 10)", "time": "substr(CAST({t} AS STRING), 12, 8)", "datetime": "substr(CAST({t} AS STRING), 1, 19)",
    "julianday": "julianday({t})", "unixepoch": "unixepoch({t})", "strftime": "strftime({f}, {t})",
}
_MICROSECONDS = {"day": 86_400_000_000, "hour": 3_600_000_000, "minute": 60_000_000, "second": 1_000_000}
_AMOUNT = re.compile(r"([+-]?\d+(?:\.\d+)?)\s+(day|hour|minute|second|month|year)s?", re.I)
_CLOCK = re.compile(r"([+-]?)(\d\d):(\d\d)(?::(\d\d(?:\.\d+)?))?")


def shifted(t: str, modifier: str) -> str:
    """The time after a modifier."""
    m = modifier.strip().lower()
    if found := _AMOUNT.fullmatch(m):
        number, unit = float(found[1]), found[2]
        if unit in _MICROSECONDS:
            return f"timestampadd(MICROSECOND, {round(number * _MICROSECONDS[unit])}L, {t})"
        if number != int(number):
            raise ValueError(f"fractions of a {unit} have no length: {modifier!r}")
        return f"shift_months({t}, {int(number) * (12 if unit == 'year' else 1)})"
    if found := _CLOCK.fullmatch(m):
        seconds = int(found[2]) * 3600 + int(found[3]) * 60 + float(found[4] or 0)
        return f"timestampadd(MICROSECOND, {round(seconds * 1e6) * (-1 if found[1] == '-' else 1)}L, {t})"
    if m in ("start of day", "start of month", "start of year"):
        return f"start_of('{m[9:]}', {t})"
    if re.fullmatch(r"weekday [0-6]", m):
        return f"next_weekday({t}, {m[8:]})"
    raise ValueError(f"unknown modifier {modifier!r}")


def call(name: str, args: list[tuple[str, str]]) -> str | None:
    """A call's Spark SQL; arguments are (kind, text), with the contents of text literals."""
    shown, rest, form = NAMES[name], list(args), ""
    literal = lambda a: "'" + a[1].replace("\\", "\\\\").replace("'", "\\'") + "'" if a[0] == "text" else a[1]
    if name == "strftime":
        if not rest:
            return None
        form = literal(rest.pop(0))
    given = rest.pop(0) if rest else ("text", "now")
    if any(kind != "text" for kind, _ in rest):
        raise ValueError(f"modifiers of {name} have to be text literals")
    modifiers = [text for _, text in rest]
    if given == ("text", "now"):
        t = "CAST(current_timestamp() AS TIMESTAMP_NTZ)"
    elif modifiers and modifiers[0].strip().lower() == "unixepoch":
        t, modifiers = f"moment_of_seconds({literal(given)})", modifiers[1:]
    else:
        t = f"moment({literal(given)})"
    for m in modifiers:
        t = shifted(t, m)
    return shown.format(t=t, f=form)
