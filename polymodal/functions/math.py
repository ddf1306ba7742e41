"""Numbers and bits."""

from __future__ import annotations


def _guard(test: str, value: str, message: str) -> str:
    return f"(CASE WHEN {test} THEN raise_error('{message}') ELSE {value} END)"


def _trunc(x, n="0"):
    return f"(sign({x}) * floor(abs({x}) * power(10, {n})) / power(10, {n}))"


def _log(a, b=None):
    if b is None:
        return _guard(f"{a} <= 0", f"log10({a})", "cannot take logarithm of a number that is not positive")
    return f"log({a}, {b})"


def idiv(a: str, b: str) -> str:
    """Integer division that truncates, in the operands' type; zero divisors raise."""
    return f"({a} div {b})"


#: Rounded where a double's last digits would hide the exact values at whole angles.
_DEG = {"sind": "round(sin(radians({0})), 15)", "cosd": "round(cos(radians({0})), 15)", "tand": "round(tan(radians({0})), 15)", "cotd": "round(1 / tan(radians({0})), 15)", "asind": "round(degrees(asin({0})), 13)", "acosd": "round(degrees(acos({0})), 13)", "atand": "round(degrees(atan({0})), 13)"}
MACROS = {
    "ceil": lambda x: f"CAST(ceil({x}) AS DOUBLE)",
    "ceiling": lambda x: f"CAST(ceil({x}) AS DOUBLE)",
    "floor": lambda x: f"CAST(floor({x}) AS DOUBLE)",
    "trunc": _trunc,
    "truncate": _trunc,
    "sqrt": lambda x: _guard(f"{x} < 0", f"sqrt({x})", "cannot take square root of a negative number"),
    "ln": lambda x: _guard(f"{x} <= 0", f"ln({x})", "cannot take logarithm of a number that is not positive"),
    "log": _log,
    "log10": _log,
    "random": lambda: "rand()",
    "random_normal": lambda m="0.0", s="1.0": f"(randn() * {s} + {m})",
    "setseed": lambda s: f"CAST({s} AS STRING)",
    "div": lambda a, b: idiv(a, b),
    "gcd": lambda a, b: f"aggregate(sequence(1, 64), struct(abs(CAST({a} AS BIGINT)) AS x, abs(CAST({b} AS BIGINT)) AS y), (s, i) -> CASE WHEN s.y = 0 THEN s ELSE struct(s.y AS x, s.x % s.y AS y) END, s -> s.x)",
    "lcm": lambda a, b: f"(CASE WHEN {a} = 0 OR {b} = 0 THEN 0 ELSE abs({a} * {b}) div {MACROS['gcd'](a, b)} END)",
    "scale": lambda x: f"char_length(regexp_extract(CAST({x} AS STRING), '\\\\.([0-9]+)$', 1))",
    "min_scale": lambda x: f"char_length(regexp_replace(regexp_extract(CAST({x} AS STRING), '\\\\.([0-9]+)$', 1), '0+$', ''))",
    "trim_scale": lambda x: f"CAST(regexp_replace(regexp_replace(CAST({x} AS STRING), '(\\\\.[0-9]*?)0+$', '$1'), '\\\\.$', '') AS STRING)",
    **{k: (lambda x, t=t: t.format(x)) for k, t in _DEG.items()},
    "atan2d": lambda y, x: f"degrees(atan2({y}, {x}))",
    "erf": lambda x: f"pm_erf(CAST({x} AS DOUBLE))",
    "erfc": lambda x: f"(1 - pm_erf(CAST({x} AS DOUBLE)))",
    "get_bit": lambda x, i: f"getbit({x}, {i})",
    "set_bit": lambda x, i, v: f"(CASE WHEN {v} = 1 THEN {x} | shiftleft(1, {i}) ELSE {x} & ~shiftleft(1, {i}) END)",
    "get_byte": lambda x, i: f"CAST(conv(hex(substring(CAST({x} AS BINARY), {i} + 1, 1)), 16, 10) AS INT)",
    "set_byte": lambda x, i, v: f"overlay(CAST({x} AS BINARY) PLACING unhex(lpad(hex({v}), 2, '0')) FROM {i} + 1 FOR 1)",
    "cashlarger": lambda a, b: f"greatest({a}, {b})",
    "cashsmaller": lambda a, b: f"least({a}, {b})",
    "num_nulls": lambda *a: "(" + " + ".join(f"CAST({x} IS NULL AS INT)" for x in a) + ")",
    "num_nonnulls": lambda *a: "(" + " + ".join(f"CAST({x} IS NOT NULL AS INT)" for x in a) + ")",
    "int4mul": lambda a, b: f"({a} * {b})",
    "numeric_inc": lambda a: f"({a} + 1)",
    "width_bucket": lambda x, lo, hi=None, n=None: f"CAST(width_bucket({x}, {lo}, {hi}, {n}) AS INT)" if n else f"size(filter({lo}, b -> b <= {x}))",
    "to_number": lambda s, f: f"(CAST(regexp_replace({s}, '[^0-9.]', '') AS DECIMAL(38, 10)) * CASE WHEN {s} RLIKE '-|<|PR' THEN -1 ELSE 1 END)",
    "newavg": lambda x: f"avg({x})",
    "newsum": lambda x: f"sum({x})",
    "newcnt": lambda x="*": f"count({x})",
    "oldcnt": lambda x="*": f"count({x})",
    "sum2": lambda a, b: f"sum({a} + {b})",
    "least_agg": lambda *a: f"min(least({', '.join(a)}))" if len(a) > 1 else f"min({a[0]})",
    "cleast_agg": lambda *a: f"min(least({', '.join(a)}))" if len(a) > 1 else f"min({a[0]})",
    "boolor_statefunc": lambda a, b: f"({a} OR {b})",
    "booland_statefunc": lambda a, b: f"({a} AND {b})",
    **{k: (lambda a, b, o=o: f"({a} {o} {b})") for k, o in (("booleq", "="), ("boolne", "<>"), ("boollt", "<"), ("boolgt", ">"), ("boolle", "<="), ("boolge", ">="))},
    **{k: (lambda x: f"hash({x})") for k in "hashfloat4 hashfloat8 hashint2 hashint4 hashint8 hashtext hashname hashoid hashbpchar hashchar hashenum hash_numeric hash_array hash_record hash_range hash_multirange time_hash interval_hash hashinet hashmacaddr hashmacaddr8 hashoidvector timestamp_hash timetz_hash uuid_hash pg_lsn_hash hash_aclitem".split()},
    **{k: (lambda x, seed="0L": f"xxhash64({x}, {seed})") for k in "hashfloat4extended hashfloat8extended hashint2extended hashint4extended hashint8extended hashtextextended hashbpcharextended hashcharextended hashenumextended hashinetextended hashmacaddrextended hashmacaddr8extended hashnameextended hashoidextended hashoidvectorextended hash_record_extended hash_array_extended hash_range_extended hash_multirange_extended".split()},
    "xid8cmp": lambda a, b: f"CAST(sign(CAST({a} AS BIGINT) - CAST({b} AS BIGINT)) AS INT)",
    "cash_words": lambda x: f"pm_cash_words(CAST({x} AS DOUBLE))",
}


_ONES = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
_TENS = "- - twenty thirty forty fifty sixty seventy eighty ninety".split()


def number_words(n: int) -> str:
    for size, name in ((10**12, "trillion"), (10**9, "billion"), (10**6, "million"), (1000, "thousand"), (100, "hundred")):
        if n >= size:
            return f"{number_words(n // size)} {name}" + (f" {number_words(n % size)}" if n % size else "")
    return _ONES[n] if n < 20 else _TENS[n // 10] + (f" {_ONES[n % 10]}" if n % 10 else "")


def cash_words(x: float) -> str:
    cents = round(abs(x) * 100)
    d, c = divmod(cents, 100)
    text = f"{number_words(d)} dollar{'s' if d != 1 else ''} and {number_words(c)} cent{'s' if c != 1 else ''}"
    text = f"minus {text}" if x < 0 else text
    return text[0].upper() + text[1:]


def udfs():
    import math

    from ._udf import elementwise

    return {"pm_erf": elementwise(lambda x: math.erf(x), "double"), "pm_cash_words": elementwise(cash_words, "string")}
