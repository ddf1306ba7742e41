"""JSON held as text. Reading a path is a built-in; what changes or compares documents is an Arrow UDF."""

from __future__ import annotations

import json as _json


def _path(*keys: str) -> str | None:
    """A literal path of get_json_object, or None if a key is no plain literal."""
    out = "$"
    for k in keys:
        k = k.strip()
        if k.startswith("'") and k.strip("'").isdigit():
            out += f"[{k.strip(chr(39))}]"
        elif k.startswith("'") and k[1:-1].replace("_", "a").isalnum():
            out += f".{k[1:-1]}"
        else:
            return None
    return out


def _extract_text(s, *keys):
    p = _path(*keys)
    return f"get_json_object({s}, '{p}')" if p else f"pm_json_path_text({s}, array({', '.join(keys)}))"


def _value(x):
    return f"to_json({x})" if x.startswith(("array(", "struct(", "named_struct(", "map(")) else x


def _object(*a):
    pairs = ", ".join(f"{k}, {v}" for k, v in zip(a[::2], a[1::2]))
    return f"to_json(named_struct({pairs}), map('ignoreNullFields', 'false'))" if pairs else "'{}'"


def _array(*a):
    return f"concat('[', concat_ws(',', {', '.join(map(_element, a))}), ']')" if a else "'[]'"


def _element(x):
    return f"coalesce(regexp_extract(to_json(named_struct('v', {x})), '^[{{]\"v\":(.*)[}}]$', 1), 'null')" if not x.upper() == "NULL" else "'null'"


def _set(s, p, v, create="true"):
    return f"pm_json_set({s}, {_texts(p)}, {v}, {create})"


def _texts(p: str) -> str:
    """A path '{a,0,b}' as an array of texts."""
    if p.startswith("'{"):
        return "array(" + ", ".join(f"'{x.strip()}'" for x in p[2:-2].split(",") if x.strip()) + ")"
    return p


def _text_pairs(*a):
    """An object of texts: from '{k, v, ...}', or from '{k, ...}' and '{v, ...}'; literals or arrays."""
    lists = [_texts(x) for x in a]
    if len(lists) == 2:
        return f"to_json(map_from_arrays({lists[0]}, {lists[1]}))"
    odd = lambda r: f"filter({lists[0]}, (x, i) -> i % 2 = {r})"
    return f"to_json(map_from_arrays({odd(0)}, {odd(1)}))"


def _json_object(*a):
    listed = a and all(x.startswith(("array(", "'{")) for x in a) and len(a) <= 2
    return _text_pairs(*a) if listed else _object(*a)


def is_json(x, form="VALUE"):
    test = {"OBJECT": f" AND schema_of_variant(try_parse_json({x})) LIKE 'OBJECT%'", "ARRAY": f" AND schema_of_variant(try_parse_json({x})) LIKE 'ARRAY%'", "SCALAR": f" AND NOT schema_of_variant(try_parse_json({x})) LIKE 'OBJECT%' AND NOT schema_of_variant(try_parse_json({x})) LIKE 'ARRAY%'"}.get(form, "")
    return f"(CASE WHEN {x} IS NULL THEN NULL ELSE coalesce(try_parse_json({x}) IS NOT NULL{test}, false) END)"


_TYPEOF = "(CASE WHEN {0} IS NULL THEN NULL WHEN trim({0}) LIKE '{{%' THEN 'object' WHEN trim({0}) LIKE '[%' THEN 'array' WHEN trim({0}) LIKE '\"%' THEN 'string' WHEN trim({0}) IN ('true', 'false') THEN 'boolean' WHEN trim({0}) = 'null' THEN 'null' ELSE 'number' END)"
_both = lambda name, f: {f"json_{name}": f, f"jsonb_{name}": f}
MACROS = {
    **_both("typeof", lambda s: _TYPEOF.format(s)),
    **_both("array_length", lambda s: f"json_array_length({s})"),
    **_both("build_object", _object), **_both("build_array", _array), "json_array": _array, "json_scalar": _element,
    "json_object": _json_object, "jsonb_object": lambda *a: _text_pairs(*a) if len(a) <= 2 and a else _object(*a),
    **_both("strip_nulls", lambda s: f"pm_json_strip_nulls({s})"),
    "jsonb_set": _set, "jsonb_set_lax": lambda s, p, v, c="true", *_: f"coalesce({_set(s, p, v, c)}, {s})", "jsonb_insert": lambda s, p, v, after="false": f"pm_json_insert({s}, {_texts(p)}, {v}, {after})",
    **_both("extract_path", lambda s, *k: f"pm_json_path({s}, array({', '.join(k)}))"), **_both("extract_path_text", _extract_text),
    "jsonb_pretty": lambda s: f"pm_json_pretty({s})", "json_serialize": lambda s: s,
    "json_value": lambda s, p: f"get_json_object({s}, {p})", "json_query": lambda s, p: f"get_json_object({s}, {p})", "json_exists": lambda s, p: f"(get_json_object({s}, {p}) IS NOT NULL)",
    **{f"jsonb_path_query_array{t}": (lambda s, p, *_: f"pm_jsonpath({s}, {p})") for t in ("", "_tz")},
    **{f"jsonb_path_query_first{t}": (lambda s, p, *_: f"get_json_object(pm_jsonpath({s}, {p}), '$[0]')") for t in ("", "_tz")},
    **{f"jsonb_path_exists{t}": (lambda s, p, *_: f"(json_array_length(pm_jsonpath({s}, {p})) > 0)") for t in ("", "_tz")},
    **{f"jsonb_path_match{t}": (lambda s, p, *_: f"(get_json_object(pm_jsonpath({s}, {p}), '$[0]') = 'true')") for t in ("", "_tz")},
    **{f"jsonb_path_query{t}": (lambda s, p, *_: f"explode(pm_json_elements(pm_jsonpath({s}, {p})))") for t in ("", "_tz")},
    **{f"array_of:{k}_array_elements": (lambda s: f"pm_json_elements({s})") for k in ("json", "jsonb")},
    **{f"array_of:{k}_array_elements_text": (lambda s: f"pm_json_elements_text({s})") for k in ("json", "jsonb")},
    **{f"array_of:{k}_object_keys": (lambda s: f"json_object_keys({s})") for k in ("json", "jsonb")},
    **{f"array_of:{k}_each": (lambda s: f"from_json({s}, 'map<string,string>')") for k in ("json", "jsonb")},
    **{f"array_of:{k}_each_text": (lambda s: f"from_json({s}, 'map<string,string>')") for k in ("json", "jsonb")},
    **_both("object_keys", lambda s: f"explode(json_object_keys({s}))"),
    "row_to_json": lambda x, *_: f"to_json({x})", "to_json": lambda x, *_: _element(x), "to_jsonb": lambda x, *_: _element(x),
    **_both("populate_record", lambda schema, s: f"from_json({s}, {schema})"), **_both("to_record", lambda s, schema: f"from_json({s}, {schema})"),
    **_both("populate_recordset", lambda schema, s: f"inline(from_json({s}, concat('array<struct<', {schema}, '>>')))"), **_both("to_recordset", lambda s, schema: f"inline(from_json({s}, concat('array<struct<', {schema}, '>>')))"),
    **_both("object_agg", lambda k, v: f"to_json(map_from_entries(collect_list(struct({k}, {v}))), map('ignoreNullFields', 'false'))"), "json_objectagg": lambda k, v: f"to_json(map_from_entries(collect_list(struct({k}, {v}))))", "json_arrayagg": lambda x: f"to_json(collect_list({x}))",
    "jsonb_concat": lambda a, b: f"pm_json_merge({a}, {b})", "jsonb_contains": lambda a, b: f"pm_json_contains({a}, {b})", "jsonb_contained": lambda a, b: f"pm_json_contains({b}, {a})",
    "jsonb_exists": lambda s, k: f"coalesce(array_contains(json_object_keys({s}), {k}), false)", "jsonb_exists_any": lambda s, k: f"coalesce(arrays_overlap(json_object_keys({s}), {k}), false)", "jsonb_exists_all": lambda s, k: f"coalesce(size(array_except({k}, json_object_keys({s}))) = 0, false)",
    "jsonb_delete": lambda s, k: f"pm_json_delete_path({s}, array(CAST({k} AS STRING)))", "jsonb_delete_path": lambda s, p: f"pm_json_delete_path({s}, {_texts(p)})",
    "jsonb_hash": lambda s: f"xxhash64({s})", "jsonb_hash_extended": lambda s, seed: f"xxhash64({s}, {seed})",
    "is_json": is_json,
}


def dumps(x) -> str:
    return _json.dumps(x, separators=(",", ":"), ensure_ascii=False)


def walk(x, path):
    """(found, value) at a path of texts."""
    for k in path:
        if isinstance(x, dict) and k in x:
            x = x[k]
        elif isinstance(x, list) and k.lstrip("-").isdigit() and -len(x) <= int(k) < len(x):
            x = x[int(k)]
        else:
            return False, None
    return True, x


def contains(a, b) -> bool:
    """jsonb containment: objects by key, arrays as sets; an array holds a scalar."""
    if isinstance(a, dict) and isinstance(b, dict):
        return all(k in a and contains(a[k], v) for k, v in b.items())
    if isinstance(a, list):
        items = b if isinstance(b, list) else [b]
        if not isinstance(b, list) and isinstance(b, dict):
            return False
        return all(any(contains(x, y) if isinstance(y, (dict, list)) else x == y and type(x) is type(y) for x in a) for y in items)
    return type(a) is type(b) and a == b


def set_path(x, path, value, create=True):
    if not path:
        return value
    k, rest = path[0], path[1:]
    if isinstance(x, dict):
        if k in x or (create and not rest):
            return {**x, k: set_path(x.get(k), rest, value, create)}
    elif isinstance(x, list) and k.lstrip("-").isdigit():
        i = int(k)
        if -len(x) <= i < len(x):
            y = list(x)
            y[i] = set_path(x[i], rest, value, create)
            return y
        if create and not rest:
            return [*x, value] if i >= 0 else [value, *x]
    return x


def insert_path(x, path, value, after):
    if len(path) > 1:
        ok, child = walk(x, path[:1])
        return set_path(x, path[:1], insert_path(child, path[1:], value, after)) if ok else x
    k = path[0]
    if isinstance(x, dict):
        return x if k in x else {**x, k: value}
    if isinstance(x, list) and k.lstrip("-").isdigit():
        i = int(k)
        i = max(0, len(x) + i if i < 0 else i)
        y = list(x)
        y.insert(i + bool(after), value)
        return y
    return x


def delete_path(x, path):
    k, rest = path[0], path[1:]
    if isinstance(x, dict) and k in x:
        return {a: (delete_path(b, rest) if rest else b) if a == k else b for a, b in x.items() if a != k or rest}
    if isinstance(x, list):
        if k.lstrip("-").isdigit() and -len(x) <= int(k) < len(x):
            i = int(k) % len(x)
            return [delete_path(b, rest) if j == i else b for j, b in enumerate(x) if j != i or rest]
        if not rest:
            return [b for b in x if b != k]
    return x


def strip_nulls(x):
    if isinstance(x, dict):
        return {k: strip_nulls(v) for k, v in x.items() if v is not None}
    return [strip_nulls(v) for v in x] if isinstance(x, list) else x


def jsonpath(doc, path: str) -> list:
    """Members, wildcards, subscripts and one-comparison filters of the path language, in lax mode."""
    import re

    path = re.sub(r"^\s*(lax|strict)\s+", "", path).strip()
    whole = re.fullmatch(r"(\$[^=<>!]*?)\s*(==|!=|<>|<=|>=|<|>)\s*(.+)", path)
    if whole and "?" not in path:
        return [any(_compare(v, whole[2], _json.loads(whole[3])) for v in jsonpath(doc, whole[1]))]
    now, at = [doc], 1
    token = re.compile(r'\s*(?:\.\s*(?:"([^"]*)"|([\w]+)(\(\))?|(\*))|\[\s*(\*|-?\d+|last)\s*(?:to\s+(\d+|last)\s*)?\]|\?\s*\(((?:[^()]|\([^()]*\))*)\))')
    while at < len(path):
        m = token.match(path, at)
        if not m:
            raise ValueError(f"unsupported path: {path}")
        at, key = m.end(), m[1] if m[1] is not None else m[2]
        if m[3]:
            now = [{"size": lambda v: len(v) if isinstance(v, list) else 1, "type": _type, "double": float, "abs": abs}[key](v) for v in now]
        elif key is not None:
            flat = [y for v in now for y in (v if isinstance(v, list) else [v])]
            now = [v[key] for v in flat if isinstance(v, dict) and key in v]
        elif m[4]:
            now = [y for v in now if isinstance(v, dict) for y in v.values()]
        elif m[5]:
            out = []
            for v in now:
                v = v if isinstance(v, list) else [v]
                if m[5] == "*":
                    out += v
                else:
                    lo = len(v) - 1 if m[5] == "last" else int(m[5])
                    hi = lo if not m[6] else len(v) - 1 if m[6] == "last" else int(m[6])
                    out += v[lo : hi + 1]
            now = out
        else:
            flat = [y for v in now for y in (v if isinstance(v, list) else [v])]
            now = [v for v in flat if _filter(v, m[7])]
    return now


def _type(v) -> str:
    return {dict: "object", list: "array", str: "string", bool: "boolean", type(None): "null"}.get(type(v), "number")


def _compare(a, op, b) -> bool:
    if op in ("==",):
        return a == b and isinstance(a, bool) == isinstance(b, bool)
    if op in ("!=", "<>"):
        return a != b
    if type(a) is not type(b) and not (isinstance(a, (int, float)) and isinstance(b, (int, float))):
        return False
    return {"<": a < b, ">": a > b, "<=": a <= b, ">=": a >= b}[op]


def _filter(v, text: str) -> bool:
    import re

    for part in text.split("||"):
        ok = True
        for cond in part.split("&&"):
            m = re.fullmatch(r"\s*(@[^=<>!]*?)\s*(==|!=|<>|<=|>=|<|>)\s*(.+?)\s*", cond)
            if m:
                ok &= any(_compare(x, m[2], _json.loads(m[3])) for x in jsonpath(v, "$" + m[1].strip()[1:]))
            elif e := re.fullmatch(r"\s*exists\s*\((@.*)\)\s*", cond):
                ok &= bool(jsonpath(v, "$" + e[1].strip()[1:]))
            else:
                raise ValueError(f"unsupported filter: {cond}")
        if ok:
            return True
    return False


def strings_of(value) -> list[str]:
    """All text values, in order; keys are none."""
    if isinstance(value, str):
        return [value]
    inner = value.values() if isinstance(value, dict) else value if isinstance(value, list) else ()
    return [s for v in inner for s in strings_of(v)]


def udfs():
    from ._udf import elementwise

    load = _json.loads

    def path(s, p):
        ok, v = walk(load(s), list(p))
        return dumps(v) if ok else None

    def path_text(s, p):
        ok, v = walk(load(s), list(p))
        return None if not ok or v is None else v if isinstance(v, str) else dumps(v)

    def elements_text(s):
        return [None if v is None else v if isinstance(v, str) else dumps(v) for v in load(s)]

    return {
        "pm_json_strings": elementwise(lambda s: " ".join(strings_of(_json.loads(s))), "string"),
        "pm_json_get": elementwise(lambda s, k: path(s, [k]), "string"), "pm_json_get_text": elementwise(lambda s, k: path_text(s, [k]), "string"), "pm_json_path": elementwise(path, "string"), "pm_json_path_text": elementwise(path_text, "string"),
        "pm_json_delete_path": elementwise(lambda s, p: dumps(delete_path(load(s), list(p))), "string"), "pm_json_set": elementwise(lambda s, p, v, c: dumps(set_path(load(s), list(p), load(v), c)), "string"), "pm_json_insert": elementwise(lambda s, p, v, a: dumps(insert_path(load(s), list(p), load(v), a)), "string"),
        "pm_json_strip_nulls": elementwise(lambda s: dumps(strip_nulls(load(s))), "string"), "pm_json_pretty": elementwise(lambda s: _json.dumps(load(s), indent=4, ensure_ascii=False), "string"), "pm_json_contains": elementwise(lambda a, b: contains(load(a), load(b)), "boolean"),
        "pm_json_merge": elementwise(lambda a, b: dumps({**x, **y} if isinstance(x := load(a), dict) and isinstance(y := load(b), dict) else [*(x if isinstance(x, list) else [x]), *((y := load(b)) if isinstance(load(b), list) else [load(b)])]), "string"),
        "pm_jsonpath": elementwise(lambda s, p: dumps(jsonpath(load(s), p)), "string"), "pm_json_elements": elementwise(lambda s: [dumps(v) for v in load(s)], "array<string>"), "pm_json_elements_text": elementwise(elements_text, "array<string>"),
    }
