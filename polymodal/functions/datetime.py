"""Dates, times and intervals. A time of day is a count of microseconds since midnight."""

from __future__ import annotations


def _part(field, t):
    f = field.strip("'").lower()
    special = {
        "dow": f"(dayofweek({t}) - 1)", "isodow": f"(weekday({t}) + 1)", "epoch": f"(unix_micros(CAST({t} AS TIMESTAMP)) / 1000000D)", "century": f"CAST(ceil(year({t}) / 100) AS INT)", "decade": f"CAST(floor(year({t}) / 10) AS INT)",
        "millennium": f"CAST(ceil(year({t}) / 1000) AS INT)", "julian": f"(datediff({t}, DATE '1970-01-01') + 2440588)", "isoyear": f"extract(YEAROFWEEK FROM {t})", "doy": f"dayofyear({t})", "second": f"CAST(extract(SECOND FROM {t}) AS DOUBLE)",
        "seconds": f"CAST(extract(SECOND FROM {t}) AS DOUBLE)", "milliseconds": f"CAST(extract(SECOND FROM {t}) * 1000 AS DOUBLE)", "microseconds": f"CAST(extract(SECOND FROM {t}) * 1000000 AS BIGINT)",
    }
    return special.get(f, f"extract({f.upper()} FROM {t})")


def _trunc(unit, t, *_):
    u = unit.strip("'").lower()
    years = {"decade": 10, "century": 100, "millennium": 1000}
    if u in years:
        n = years[u]
        year = f"CAST(floor(year({t}) / {n}) * {n} AS INT)" if u == "decade" else f"CAST(floor((year({t}) - 1) / {n}) * {n} + 1 AS INT)"
        return f"CAST(make_date({year}, 1, 1) AS TIMESTAMP_NTZ)"
    return f"date_trunc('{u.upper()}', {t})"


def _age(a, b=None):
    a, b = (a, b) if b else ("current_date()", a)
    months = f"CAST(floor(months_between({a}, {b})) AS INT)"
    rest = f"(unix_micros(CAST({a} AS TIMESTAMP)) - unix_micros(CAST(add_months({b}, {months}) AS TIMESTAMP)) - (unix_micros(CAST({b} AS TIMESTAMP)) - unix_micros(CAST(CAST({b} AS DATE) AS TIMESTAMP))))"
    return f"struct({months} AS months, CAST({rest} div 86400000000 AS INT) AS days, {rest} % 86400000000 AS micros)"


_FORMATS = (("YYYY", "yyyy"), ("YY", "yy"), ("Month", "MMMM"), ("MON", "MMM"), ("Mon", "MMM"), ("DDD", "DDD"), ("DD", "dd"), ("HH24", "HH"), ("HH12", "hh"), ("HH", "hh"), ("MI", "mm"), ("SS", "ss"), ("MS", "SSS"), ("US", "SSSSSS"), ("AM", "a"), ("PM", "a"), ("Day", "EEEE"), ("Dy", "E"), ("Q", "Q"), ("TZ", "z"))


def pattern(fmt: str) -> str:
    """A template of the dialect as a pattern of Spark."""
    out, i, s = "", 0, fmt.strip("'")
    while i < len(s):
        for a, b in _FORMATS:
            if s.startswith(a, i):
                out, i = out + b, i + len(a)
                break
        else:
            out, i = out + s[i], i + 1
    return f"'{out}'"


def _to_char(x, fmt):
    f = fmt.strip("'")
    if any(c in f for c in "90") and not any(k in f for k in ("YYYY", "HH", "MM", "DD")):
        return f"to_char({x}, '{f.replace('FM', '')}')"
    return f"date_format({x}, {pattern(fmt.replace('FM', ''))})"


def _bin(stride, t, origin="TIMESTAMP_NTZ '1970-01-01 00:00:00'"):
    step = f"pm_micros({stride})"
    us = lambda x: f"unix_micros(CAST({x} AS TIMESTAMP))"
    return f"CAST(timestamp_micros({us(origin)} + CAST(floor(({us(t)} - {us(origin)}) / {step}) AS BIGINT) * {step}) AS TIMESTAMP_NTZ)"


def interval_micros(text: str) -> int:
    """Microseconds of an interval literal of days and smaller units."""
    import re

    unit = {"us": 1, "microsecond": 1, "ms": 1000, "millisecond": 1000, "s": 10**6, "sec": 10**6, "second": 10**6, "min": 6 * 10**7, "minute": 6 * 10**7, "h": 36 * 10**8, "hour": 36 * 10**8, "day": 864 * 10**8, "week": 6048 * 10**8}
    total = 0
    for n, u in re.findall(r"([+-]?\d+(?:\.\d+)?)\s*([a-z]+)", text.lower()):
        key = u if u in unit else u.rstrip("s")
        if key not in unit:
            raise ValueError(f"no fixed length: {u}")
        total += round(float(n) * unit[key])
    return total


def _bin_literal(stride, t, *origin):
    import re

    m = re.search(r"'([^']*)'", stride)
    if not m:
        raise ValueError("the stride of date_bin is a literal")
    return _bin(stride, t, *origin).replace(f"pm_micros({stride})", str(interval_micros(m[1])))


def _timezone(zone, t):
    return f"from_utc_timestamp({t}, {zone})"


def _time(h, m, s):
    return f"CAST(({h} * 3600 + {m} * 60 + {s}) * 1000000L AS BIGINT)"


_NOW = {k: (lambda *_: "current_timestamp()") for k in ("now", "current_timestamp", "clock_timestamp", "statement_timestamp", "transaction_timestamp")}
_TOD = {k: (lambda *_: "(unix_micros(current_timestamp()) % 86400000000)") for k in ("current_time", "localtime")}
MACROS = {
    **_NOW,
    **_TOD,
    "date_part": _part,
    "extract": _part,
    "date_trunc": _trunc,
    "age": _age,
    "to_char": _to_char,
    "to_date": lambda s, f: f"to_date({s}, {pattern(f)})",
    "to_timestamp": lambda s, f=None: f"to_timestamp({s}, {pattern(f)})" if f else f"timestamp_seconds({s})",
    "make_time": _time,
    "make_timestamp": lambda *a: f"make_timestamp_ntz({', '.join(a)})",
    "make_timestamptz": lambda *a: f"make_timestamp_ltz({', '.join(a)})",
    "make_interval": lambda *a: f"make_interval({', '.join(x.split('=>')[-1] for x in a)})",
    "timezone": _timezone,
    "date_bin": _bin_literal,
    "date_add": lambda t, i: f"({t} + {i})",
    "date_subtract": lambda t, i: f"({t} - {i})",
    "justify_days": lambda i: f"struct({i}.months + {i}.days div 30 AS months, {i}.days % 30 AS days, {i}.micros AS micros)",
    "justify_hours": lambda i: f"struct({i}.months AS months, CAST({i}.days + {i}.micros div 86400000000 AS INT) AS days, {i}.micros % 86400000000 AS micros)",
    "justify_interval": lambda i: f"struct(CAST({i}.months + ({i}.days + {i}.micros div 86400000000) div 30 AS INT) AS months, CAST(({i}.days + {i}.micros div 86400000000) % 30 AS INT) AS days, {i}.micros % 86400000000 AS micros)",
    "isfinite": lambda t: f"({t} IS NOT NULL)",
    "timeofday": lambda: "date_format(current_timestamp(), 'E MMM dd HH:mm:ss.SSSSSS yyyy z')",
    "overlaps": lambda a, b, c, d: f"(least({a}, {b}) < greatest({c}, {d}) AND least({c}, {d}) < greatest({a}, {b}))",
    "date.truncate": _trunc, "datetime.truncate": _trunc, "localdatetime.truncate": _trunc,
    "time.truncate": lambda u, t: f"({t} - {t} % {interval_micros('1 ' + u.strip(chr(39)))})", "localtime.truncate": lambda u, t: f"({t} - {t} % {interval_micros('1 ' + u.strip(chr(39)))})",
    "duration.between": lambda a, b: _age(b, a),
    "duration.inmonths": lambda a, b: f"CAST(months_between({b}, {a}) AS INT)",
    "duration.indays": lambda a, b: f"datediff({b}, {a})",
    "duration.inseconds": lambda a, b: f"timestampdiff(SECOND, {a}, {b})",
    "datetime": lambda s="current_timestamp()": f"to_timestamp({s})", "cypher_datetime": lambda s="current_timestamp()": f"to_timestamp({s})",
    "localdatetime": lambda s="localtimestamp()": f"CAST({s} AS TIMESTAMP_NTZ)", "cypher_localdatetime": lambda s="localtimestamp()": f"CAST({s} AS TIMESTAMP_NTZ)",
    "cypher_date": lambda s="current_date()": f"CAST({s} AS DATE)",
    "time": lambda s: f"(unix_micros(to_timestamp(concat('1970-01-01 ', {s}))))", "cypher_time": lambda s: f"(unix_micros(to_timestamp(concat('1970-01-01 ', {s}))))", "cypher_localtime": lambda s: f"(unix_micros(to_timestamp(concat('1970-01-01 ', {s}))))",
    "duration": lambda s: f"CAST({s} AS INTERVAL)", "cypher_duration": lambda s: f"CAST({s} AS INTERVAL)",
}
