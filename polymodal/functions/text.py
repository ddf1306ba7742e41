"""Text, regular expressions, encodings."""

from __future__ import annotations

import re


def similar_pattern(p: str) -> str:
    """A SIMILAR TO pattern as an anchored regular expression."""
    out, i = "", 0
    while i < len(p):
        c = p[i]
        if c == "\\" and i + 1 < len(p):
            out, i = out + re.escape(p[i + 1]), i + 1
        elif c == "%":
            out += ".*"
        elif c == "_":
            out += "."
        elif c in "|*+?{}()[]":
            out += c
        else:
            out += re.escape(c)
        i += 1
    return f"^(?:{out})$"


def _flags(flags: str | None) -> str:
    f = (flags or "''").strip("'").replace("g", "")
    return f"(?{f})" if f else ""


def _pattern(p: str, flags: str | None) -> str:
    f = _flags(flags)
    return f"concat('{f}', {p})" if f else p


def _regexp_replace(s, p, r, *more):
    flags = more[-1] if more and more[-1].startswith("'") else "''"
    r = re.sub(r"\\\\(\d)", r"$\1", r)
    if "g" in flags:
        return f"regexp_replace({s}, {_pattern(p, flags)}, {r})"
    # only the first match: what comes before it, the match rewritten, the rest
    pat = _pattern(p, flags)
    return f"(CASE WHEN regexp_instr({s}, {pat}) = 0 THEN {s} ELSE concat(substring({s}, 1, regexp_instr({s}, {pat}) - 1), regexp_replace(regexp_substr({s}, {pat}), {pat}, {r}), substring({s}, regexp_instr({s}, {pat}) + char_length(regexp_substr({s}, {pat})))) END)"


def _substring(s, start="1", n=None):
    if n is None:
        return f"substring({s}, greatest({start}, 1))"
    return f"substring({s}, greatest({start}, 1), greatest({n} + least({start} - 1, 0), 0))"


def _left(s, n):
    return f"substring({s}, 1, CASE WHEN {n} < 0 THEN greatest(char_length({s}) + {n}, 0) ELSE {n} END)"


def _right(s, n):
    return f"(CASE WHEN {n} < 0 THEN substring({s}, 1 - ({n})) ELSE right({s}, {n}) END)"


def _initcap(s):
    # upper case after every character that is no letter or digit
    return f"array_join(transform(regexp_extract_all(lower({s}), '([a-z0-9\\\\p{{L}}\\\\p{{N}}]+|[^a-z0-9\\\\p{{L}}\\\\p{{N}}]+)', 1), w -> concat(upper(substring(w, 1, 1)), substring(w, 2))), '')"


def _format(fmt, *args):
    """format('...%s %I %L', ...) with a literal pattern."""
    out, n, parts = fmt.strip("'"), 0, []
    for m in re.finditer(r"%(?:(\d+)\$)?-?\d*([sIL%])|[^%]+", out):
        if m[2] is None:
            parts.append(f"'{m[0]}'")
        elif m[2] == "%":
            parts.append("'%'")
        else:
            k = int(m[1]) - 1 if m[1] else n
            n = k + 1
            a = args[k]
            parts.append(f"coalesce(CAST({a} AS STRING), '')" if m[2] == "s" else MACROS["quote_ident"](a) if m[2] == "I" else MACROS["quote_nullable"](a))
    return f"concat({', '.join(parts)})" if parts else "''"


def _quote_literal(s):
    return f"concat('\\'', replace(CAST({s} AS STRING), '\\'', '\\'\\''), '\\'')"


def _encode(x, fmt):
    kind = fmt.strip("'").lower()
    return {"base64": f"base64(CAST({x} AS BINARY))", "hex": f"lower(hex(CAST({x} AS BINARY)))"}.get(kind, f"decode(CAST({x} AS BINARY), 'UTF-8')")


def _decode(x, fmt):
    kind = fmt.strip("'").lower()
    return {"base64": f"unbase64({x})", "hex": f"unhex({x})"}.get(kind, f"encode({x}, 'UTF-8')")


def _digest(x, kind="'sha256'"):
    k = kind.strip("'").lower()
    return f"unhex(md5({x}))" if k == "md5" else f"unhex(sha1({x}))" if k == "sha1" else f"unhex(sha2({x}, {k.removeprefix('sha')}))"


def _charset(c: str) -> str:
    return {"'utf8'": "'UTF-8'", "'latin1'": "'ISO-8859-1'", "'sql_ascii'": "'US-ASCII'"}.get(c.lower(), c)


def _nth_match(s, p, start, n):
    """Place and text of the n-th match from a place on, as a struct (pos 0 without one)."""
    rest = f"substring({s}, __a.off + 1)"
    found = f"regexp_instr({rest}, {p})"
    step = f"CASE WHEN {found} = 0 THEN struct(char_length({s}) AS off, 0 AS pos, CAST(NULL AS STRING) AS hit) ELSE struct(__a.off + {found} - 1 + char_length(regexp_substr({rest}, {p})) AS off, __a.off + {found} AS pos, regexp_substr({rest}, {p}) AS hit) END"
    return f"aggregate(sequence(1, {n}), struct({start} - 1 AS off, 0 AS pos, CAST(NULL AS STRING) AS hit), (__a, __i) -> {step})"


def _regexp_instr(s, p, start="1", n="1", *more):
    return f"regexp_instr({s}, {p})" if (start, n) == ("1", "1") else f"{_nth_match(s, p, start, n)}.pos"


def _regexp_substr(s, p, start="1", n="1", *more):
    return f"regexp_substr({s}, {p})" if (start, n) == ("1", "1") else f"{_nth_match(s, p, start, n)}.hit"


MACROS = {
    "length": lambda s, *_: f"char_length({s})",
    "substring": _substring,
    "substr": _substring,
    "strpos": lambda s, sub: f"locate({sub}, {s})",
    "left": _left,
    "right": _right,
    "replace": lambda s, a, b: f"(CASE WHEN {a} = '' THEN {s} ELSE replace({s}, {a}, {b}) END)",
    "starts_with": lambda s, p: f"startswith({s}, {p})",
    "concat": lambda *a: f"concat_ws('', {', '.join(f'CAST({x} AS STRING)' for x in a)})" if a else "''",
    "initcap": _initcap,
    "chr": lambda n: f"decode(unhex(lpad(hex({n}), 8, '0')), 'UTF-32')",
    "to_hex": lambda n: f"lower(hex({n}))",
    "fipshash": lambda s: f"substring(sha2({s}, 256), 1, 32)",
    "quote_literal": _quote_literal,
    "quote_nullable": lambda s: f"coalesce({_quote_literal(s)}, 'NULL')",
    "quote_ident": lambda s: f"(CASE WHEN {s} RLIKE '^[a-z_][a-z0-9_]*$' THEN {s} ELSE concat('\"', replace({s}, '\"', '\"\"'), '\"') END)",
    "regexp_replace": _regexp_replace,
    "regexp_match": lambda s, p, f=None: f"pm_regexp_match({s}, {_pattern(p, f)})",
    "regexp_substr": _regexp_substr,
    "regexp_instr": _regexp_instr,
    "regexp_count": lambda s, p, start="1", f=None: f"regexp_count({s if start == '1' else f'substring({s}, {start})'}, {_pattern(p, f)})",
    "regexp_like": lambda s, p, f=None: f"({s} RLIKE {_pattern(p, f)})",
    "regexp_split_to_array": lambda s, p, f=None: f"split({s}, {_pattern(p, f)})",
    "array_of:regexp_split_to_table": lambda s, p, f=None: f"split({s}, {_pattern(p, f)})",
    "array_of:string_to_table": lambda s, d, *n: MACROS_LATE["string_to_array"](s, d, *n),
    "array_of:regexp_matches": lambda s, p, f=None: f"transform(regexp_extract_all({s}, {_pattern(p, f)}, 0), x -> array(x))" if f and "g" in f else f"array(pm_regexp_match({s}, {_pattern(p, f)}))",
    "unistr": lambda s: f"pm_unistr({s})",
    "btrim": lambda s, c="' '": f"trim(BOTH {c} FROM {s})",
    "ltrim": lambda s, c="' '": f"trim(LEADING {c} FROM {s})",
    "rtrim": lambda s, c="' '": f"trim(TRAILING {c} FROM {s})",
    "trim": lambda s, c="' '": f"trim(BOTH {c} FROM {s})",
    "sha224": lambda x: f"unhex(sha2({x}, 224))",
    "sha256": lambda x: f"unhex(sha2({x}, 256))",
    "sha384": lambda x: f"unhex(sha2({x}, 384))",
    "sha512": lambda x: f"unhex(sha2({x}, 512))",
    "digest": _digest,
    "encode": _encode,
    "decode": _decode,
    "convert_from": lambda x, c: f"decode({x}, {_charset(c)})",
    "convert_to": lambda x, c: f"encode({x}, {_charset(c)})",
    "convert": lambda x, a, b: f"encode(decode({x}, {_charset(a)}), {_charset(b)})",
    "format": _format,
    "normalize": lambda s, f="'NFC'": f"pm_normalize({s}, {f})",
    "is_normalized": lambda s, f="'NFC'": f"({s} = pm_normalize({s}, {f}))",
    "parse_ident": lambda s, *_: f"transform(split({s}, '\\\\.'), x -> CASE WHEN startswith(x, '\"') THEN trim(BOTH '\"' FROM x) ELSE lower(x) END)",
    "gen_random_uuid": lambda: "uuid()",
    "uuid_generate_v4": lambda: "uuid()",
    "split_part": lambda s, d, n: f"split_part({s}, {d}, {n})",
}
MACROS_LATE: dict = {}


def udfs():
    import unicodedata

    from ._udf import elementwise

    def match(s, p):
        m = re.search(re.sub(r"\(\?<(\w)", r"(?P<\1", p), s)
        return None if not m else list(m.groups()) if m.re.groups else [m[0]]

    def unistr(s):
        s = re.sub(r"\\\+([0-9a-fA-F]{6})", lambda m: chr(int(m[1], 16)), s)
        s = re.sub(r"\\u?([0-9a-fA-F]{4})", lambda m: chr(int(m[1], 16)), s)
        return re.sub(r"\\U([0-9a-fA-F]{8})", lambda m: chr(int(m[1], 16)), s).replace("\\\\", "\\")

    return {
        "pm_regexp_match": elementwise(match, "array<string>"),
        "pm_unistr": elementwise(unistr, "string"),
        "pm_normalize": elementwise(lambda s, f: unicodedata.normalize(f.upper(), s), "string"),
    }
