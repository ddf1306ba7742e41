"""Ranges as structs (lower, upper, lower_inc, upper_inc, empty), a null bound being infinite; multiranges as arrays of disjoint, sorted ranges."""

from __future__ import annotations


def build(lo, hi, bounds="'[)'", discrete=False, step="1"):
    """A range in canonical form; discrete ones are [lo, hi)."""
    b = bounds.strip("'")
    if discrete:
        lower = f"({lo} + {step})" if b[0] == "(" else lo
        upper = f"({hi} + {step})" if b[1] == "]" else hi
        return f"struct({lower} AS lower, {upper} AS upper, ({lower} IS NOT NULL) AS lower_inc, false AS upper_inc, coalesce({lower} >= {upper}, false) AS empty)"
    li, ui = str(b[0] == "[").lower(), str(b[1] == "]").lower()
    return f"struct({lo} AS lower, {hi} AS upper, ({lo} IS NOT NULL AND {li}) AS lower_inc, ({hi} IS NOT NULL AND {ui}) AS upper_inc, coalesce({lo} > {hi} OR ({lo} = {hi} AND NOT ({li} AND {ui})), false) AS empty)"


def contains_elem(r, x):
    return f"(NOT {r}.empty AND ({r}.lower IS NULL OR {r}.lower < {x} OR ({r}.lower = {x} AND {r}.lower_inc)) AND ({r}.upper IS NULL OR {x} < {r}.upper OR ({x} = {r}.upper AND {r}.upper_inc)))"


def _starts_no_later(a, b):
    return f"({a}.lower IS NULL OR (b_lower({b}) IS NOT NULL AND ({a}.lower < {b}.lower OR ({a}.lower = {b}.lower AND ({a}.lower_inc OR NOT {b}.lower_inc)))))".replace(f"b_lower({b})", f"{b}.lower")


def _ends_no_earlier(a, b):
    return f"({a}.upper IS NULL OR ({b}.upper IS NOT NULL AND ({a}.upper > {b}.upper OR ({a}.upper = {b}.upper AND ({a}.upper_inc OR NOT {b}.upper_inc)))))"


def contains_range(a, b):
    return f"({b}.empty OR (NOT {a}.empty AND {_starts_no_later(a, b)} AND {_ends_no_earlier(a, b)}))"


def contains(a, b):
    return contains_range(a, b) if "lower_inc" in b or b.endswith("_range") else contains_elem(a, b)


def _before(a, b):
    """All of a lies before all of b."""
    return f"coalesce({a}.upper < {b}.lower OR ({a}.upper = {b}.lower AND NOT ({a}.upper_inc AND {b}.lower_inc)), false)"


def overlaps(a, b):
    return f"(NOT {a}.empty AND NOT {b}.empty AND NOT {_before(a, b)} AND NOT {_before(b, a)})"


def _merge(a, b):
    lo_null, hi_null = f"({a}.lower IS NULL OR {b}.lower IS NULL)", f"({a}.upper IS NULL OR {b}.upper IS NULL)"
    return f"(CASE WHEN {a}.empty THEN {b} WHEN {b}.empty THEN {a} ELSE struct(CASE WHEN NOT {lo_null} THEN least({a}.lower, {b}.lower) END AS lower, CASE WHEN NOT {hi_null} THEN greatest({a}.upper, {b}.upper) END AS upper, CASE WHEN {lo_null} THEN false WHEN {a}.lower < {b}.lower THEN {a}.lower_inc WHEN {b}.lower < {a}.lower THEN {b}.lower_inc ELSE {a}.lower_inc OR {b}.lower_inc END AS lower_inc, CASE WHEN {hi_null} THEN false WHEN {a}.upper > {b}.upper THEN {a}.upper_inc WHEN {b}.upper > {a}.upper THEN {b}.upper_inc ELSE {a}.upper_inc OR {b}.upper_inc END AS upper_inc, false AS empty) END)"


def _intersect(a, b):
    lo, hi = f"greatest({a}.lower, {b}.lower)", f"least({a}.upper, {b}.upper)"
    li = f"({lo} IS NOT NULL AND (NOT coalesce({a}.lower = {lo}, false) OR {a}.lower_inc) AND (NOT coalesce({b}.lower = {lo}, false) OR {b}.lower_inc))"
    ui = f"({hi} IS NOT NULL AND (NOT coalesce({a}.upper = {hi}, false) OR {a}.upper_inc) AND (NOT coalesce({b}.upper = {hi}, false) OR {b}.upper_inc))"
    return f"struct({lo} AS lower, {hi} AS upper, {li} AS lower_inc, {ui} AS upper_inc, ({a}.empty OR {b}.empty OR coalesce({lo} > {hi} OR ({lo} = {hi} AND NOT ({li} AND {ui})), false)) AS empty)"


def _adjacent(a, b):
    return f"(NOT {a}.empty AND NOT {b}.empty AND (coalesce({a}.upper = {b}.lower AND {a}.upper_inc <> {b}.lower_inc, false) OR coalesce({b}.upper = {a}.lower AND {b}.upper_inc <> {a}.lower_inc, false)))"


def _minus(a, b):
    """What b leaves of a where that is one range."""
    nothing = f"named_struct('lower', {a}.lower, 'upper', {a}.upper, 'lower_inc', {a}.lower_inc, 'upper_inc', {a}.upper_inc, 'empty', true)"
    left = f"struct({a}.lower AS lower, {b}.lower AS upper, {a}.lower_inc AS lower_inc, NOT {b}.lower_inc AS upper_inc, false AS empty)"
    right = f"struct({b}.upper AS lower, {a}.upper AS upper, NOT {b}.upper_inc AS lower_inc, {a}.upper_inc AS upper_inc, false AS empty)"
    return f"(CASE WHEN NOT {overlaps(a, b)} THEN {a} WHEN {contains_range(b, a)} THEN {nothing} WHEN {_starts_no_later(b, a)} THEN {right} WHEN {_ends_no_earlier(b, a)} THEN {left} ELSE raise_error('result of range difference would not be contiguous') END)"


def multirange(*ranges):
    """Sorted, joined where they touch."""
    rows = f"array_sort(filter(array({', '.join(ranges)}), r -> NOT r.empty), (x, y) -> CASE WHEN x.lower IS NULL AND y.lower IS NOT NULL THEN -1 WHEN y.lower IS NULL AND x.lower IS NOT NULL THEN 1 WHEN x.lower < y.lower THEN -1 WHEN x.lower > y.lower THEN 1 ELSE 0 END)"
    return join_sorted(rows)


def join_sorted(rows):
    last = "element_at(s, -1)"
    touch = f"(size(s) > 0 AND ({overlaps(last, 'r')} OR {_adjacent(last, 'r')}))"
    return f"aggregate({rows}, slice({rows}, 1, 0), (s, r) -> CASE WHEN {touch} THEN concat(slice(s, 1, size(s) - 1), array({_merge(last, 'r')})) ELSE concat(s, array(r)) END)".replace("element_at(s, -1)", "try_element_at(s, -1)")


_DISCRETE = {"int4range": "1", "int8range": "1L", "daterange": "1"}
MACROS = {
    **{k: (lambda a, b, c="'[)'", k=k: build(a, b, c, True, _DISCRETE[k])) for k in _DISCRETE},
    **{k: (lambda a, b, c="'[)'": build(a, b, c)) for k in ("numrange", "tsrange", "tstzrange", "float8range", "textrange", "textrange1", "textrange2", "textrange_c", "textrange_en_us", "arrayrange", "two_ints_range")},
    **{k: multirange for k in ("int4multirange", "int8multirange", "nummultirange", "datemultirange", "tsmultirange", "tstzmultirange", "float8multirange", "multirange", "textmultirange", "arraymultirange", "intr_multirange", "two_ints_multirange")},
    "isempty": lambda r: f"{r}.empty", "lower_inc": lambda r: f"{r}.lower_inc", "upper_inc": lambda r: f"{r}.upper_inc", "lower_inf": lambda r: f"({r}.lower IS NULL AND NOT {r}.empty)", "upper_inf": lambda r: f"({r}.upper IS NULL AND NOT {r}.empty)",
    "range_lower": lambda r: f"{r}.lower", "range_upper": lambda r: f"{r}.upper",
    "range_contains": contains_range, "range_contains_elem": contains_elem, "range_contained_by": lambda a, b: contains_range(b, a), "elem_contained_by_range": lambda x, r: contains_elem(r, x), "range_overlaps": overlaps, "range_adjacent": _adjacent, "range_merge": _merge, "range_intersect": _intersect, "range_minus": _minus, "range_before": _before, "range_after": lambda a, b: _before(b, a),
    "range_not_extend_right": lambda a, b: _ends_no_earlier(b, a), "range_not_extend_left": lambda a, b: _starts_no_later(b, a),
    "multirange_contains_elem": lambda m, x: f"exists({m}, r -> {contains_elem('r', x)})", "elem_contained_by_multirange": lambda x, m: f"exists({m}, r -> {contains_elem('r', x)})", "multirange_contains_range": lambda m, x: f"exists({m}, r -> {contains_range('r', x)})", "range_contained_by_multirange": lambda x, m: f"exists({m}, r -> {contains_range('r', x)})",
    "multirange_overlaps_multirange": lambda a, b: f"exists({a}, r -> exists({b}, q -> {overlaps('r', 'q')}))", "range_overlaps_multirange": lambda a, b: f"exists({b}, q -> {overlaps(a, 'q')})", "multirange_overlaps_range": lambda a, b: f"exists({a}, q -> {overlaps('q', b)})", "multirange_contains_multirange": lambda a, b: f"forall({b}, q -> exists({a}, r -> {contains_range('r', 'q')}))", "multirange_contained_by_multirange": lambda b, a: f"forall({b}, q -> exists({a}, r -> {contains_range('r', 'q')}))",
    "range_agg": lambda r: join_sorted(f"array_sort(filter(collect_list({r}), r -> NOT r.empty), (x, y) -> CASE WHEN x.lower IS NULL AND y.lower IS NOT NULL THEN -1 WHEN y.lower IS NULL AND x.lower IS NOT NULL THEN 1 WHEN x.lower < y.lower THEN -1 WHEN x.lower > y.lower THEN 1 ELSE 0 END)"),
    "range_intersect_agg": lambda r: f"aggregate(collect_list({r}), try_element_at(collect_list({r}), 1), (s, q) -> {_intersect('s', 'q')})",
}
