"""Arrays: 1-based, out of range is NULL, empty arrays have no length."""

from __future__ import annotations

from . import text


def _length(a, d="1"):
    return f"nullif(size({a}), 0)" if d == "1" else f"nullif(size({a}[0]), 0)"


def _string_to_array(s, d, null=None):
    out = f"split({s}, concat('\\\\Q', {d}, '\\\\E'), -1)" if d.upper() != "NULL" else f"split({s}, '')"
    if null:
        out = f"transform({out}, __x -> nullif(__x, {null}))"
    return f"(CASE WHEN {s} = '' THEN array() ELSE {out} END)"


text.MACROS_LATE["string_to_array"] = _string_to_array


def contains(a, b):
    """@> of arrays: every element of b is in a; NULL elements never match."""
    return f"(size(array_except({b}, {a})) = 0 AND NOT exists({b}, __x -> __x IS NULL))"


def _any_contains(a, b):
    """@> by the look of the operands: JSON text literals, ranges, arrays."""
    if a.startswith(("'", "pm_json", "get_json_object")) or b.startswith(("'{", "'[", "pm_json")) or b.startswith("CAST('") and b.endswith("STRING)"):
        return f"pm_json_contains({a}, {b})"
    if "pm_range" in a or "AS lower_inc" in a or a.endswith("_range"):
        from . import ranges

        return ranges.contains(a, b)
    return contains(a, b)


def _overlap(a, b):
    if "AS lower_inc" in a or a.endswith("_range"):
        from . import ranges

        return ranges.overlaps(a, b)
    return f"arrays_overlap({a}, {b})"


MACROS = {
    "array_length": _length,
    "array_upper": _length,
    "array_lower": lambda a, d="1": f"(CASE WHEN size({a}) > 0 THEN 1 END)",
    "array_position": lambda a, x, s="1": f"nullif(array_position({a}, {x}), 0)" if s == "1" else f"(CASE WHEN array_position(slice({a}, {s}, size({a})), {x}) > 0 THEN array_position(slice({a}, {s}, size({a})), {x}) + {s} - 1 END)",
    "array_positions": lambda a, x: f"filter(transform({a}, (__v, __i) -> CASE WHEN __v <=> {x} THEN __i + 1 END), __p -> __p IS NOT NULL)",
    "array_remove": lambda a, x: f"filter({a}, __v -> NOT (__v <=> {x}))",
    "array_replace": lambda a, x, y: f"transform({a}, __v -> CASE WHEN __v <=> {x} THEN {y} ELSE __v END)",
    "array_cat": lambda a, b: f"concat({a}, {b})",
    "array_prepend": lambda x, a: f"array_prepend({a}, {x})",
    "array_to_string": lambda a, s, n=None: f"array_join(transform({a}, __v -> CAST(__v AS STRING)), {s}{f', {n}' if n else ''})",
    "cardinality": lambda a: f"size({a})",
    "array_get": lambda a, i: f"get({a}, CAST({i} AS INT) - 1)",
    "array_ndims": lambda a: f"(CASE WHEN size({a}) > 0 THEN CASE WHEN typeof({a}) LIKE 'array<array<array%' THEN 3 WHEN typeof({a}) LIKE 'array<array%' THEN 2 ELSE 1 END END)",
    "array_dims": lambda a: f"(CASE WHEN size({a}) > 0 THEN concat('[1:', size({a}), ']', coalesce(concat('[1:', json_array_length(get_json_object(to_json({a}), '$[0]')), ']'), '')) END)",
    "string_to_array": _string_to_array,
    "array_fill": lambda v, n, *_: f"array_repeat({v}, {f'get({n}, 0)' if n.startswith('array') else n})",
    "array_sample": lambda a, n: f"slice(shuffle({a}), 1, {n})",
    "array_shuffle": lambda a: f"shuffle({a})",
    "trim_array": lambda a, n: f"slice({a}, 1, greatest(size({a}) - {n}, 0))",
    "array_to_json": lambda a, *_: f"to_json({a})",
    "array_of:generate_series": lambda a, b, *s: f"sequence({', '.join((a, b, *s))})" if s else f"(CASE WHEN {a} <= {b} THEN sequence({a}, {b}) ELSE array() END)",
    "array_of:generate_subscripts": lambda a, d="1": f"(CASE WHEN size({a}) > 0 THEN sequence(1, size({a})) ELSE array() END)",
    "array_of:unnest": lambda a, *more: f"arrays_zip({', '.join((a, *more))})" if more else a,
    "generate_series": lambda a, b, *s: f"explode(sequence({', '.join((a, b, *s))}))",
    "generate_subscripts": lambda a, d="1": f"explode(sequence(1, size({a})))",
    "unnest": lambda a: f"explode({a})",
    "contains": _any_contains,
    "overlap": _overlap,
    "range": lambda a, b, s="1": f"(CASE WHEN ({b} - ({a})) * ({s}) < 0 THEN array() ELSE sequence({a}, {b}, {s}) END)",
    "size": lambda x: f"(CASE WHEN typeof({x}) = 'string' THEN char_length(CAST({x} AS STRING)) END)" if x.startswith("'") else f"size({x})",
    "head": lambda a: f"get({a}, 0)",
    "last": lambda a: f"try_element_at({a}, -1)",
    "tail": lambda a: f"(CASE WHEN size({a}) > 1 THEN slice({a}, 2, size({a}) - 1) ELSE slice({a}, 1, 0) END)",
    "keys": lambda m: f"map_keys({m})",
    "row": lambda *a: f"struct({', '.join(f'{x} AS f{k}' for k, x in enumerate(a, 1))})",
    "pg_typeof": lambda x: f"(CASE typeof({x}) WHEN 'int' THEN 'integer' WHEN 'string' THEN 'text' WHEN 'double' THEN 'double precision' WHEN 'float' THEN 'real' WHEN 'timestamp' THEN 'timestamp with time zone' WHEN 'timestamp_ntz' THEN 'timestamp without time zone' WHEN 'binary' THEN 'bytea' ELSE CASE WHEN typeof({x}) LIKE 'decimal%' THEN 'numeric' ELSE typeof({x}) END END)",
}
