"""Vectors as array<float>: distances, arithmetic, conversions. All in higher-order functions, summed in double precision."""

from __future__ import annotations


def _same(a: str, b: str, value: str) -> str:
    return f"(CASE WHEN size({a}) <> size({b}) THEN raise_error('different vector dimensions') ELSE {value} END)"


def _dot(a: str, b: str) -> str:
    return f"aggregate(zip_with({a}, {b}, (x, y) -> CAST(x AS DOUBLE) * CAST(y AS DOUBLE)), 0D, (s, v) -> s + v)"


def _norm(a: str) -> str:
    return f"sqrt(aggregate({a}, 0D, (s, x) -> s + CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))"


def _l2(a, b):
    return _same(a, b, f"sqrt(aggregate(zip_with({a}, {b}, (x, y) -> power(CAST(x AS DOUBLE) - CAST(y AS DOUBLE), 2)), 0D, (s, v) -> s + v))")


def _l1(a, b):
    return _same(a, b, f"aggregate(zip_with({a}, {b}, (x, y) -> abs(CAST(x AS DOUBLE) - CAST(y AS DOUBLE))), 0D, (s, v) -> s + v)")


def _bits(a, b, op):
    return f"aggregate(zip_with(split({a}, ''), split({b}, ''), (x, y) -> CASE WHEN {op} THEN 1 ELSE 0 END), 0, (s, v) -> s + v)"


def _parse(s, *_):
    return f"from_json({s}, 'array<float>')"


def _sparse(s, *_):
    entries = f"transform(filter(split(regexp_extract({s}, '[{{](.*)[}}]', 1), ','), e -> e <> ''), e -> struct(CAST(trim(split_part(e, ':', 1)) AS INT) AS i, CAST(trim(split_part(e, ':', 2)) AS FLOAT) AS v))"
    return f"transform(sequence(1, CAST(regexp_extract({s}, '/([0-9]+)', 1) AS INT)), k -> coalesce(get(filter({entries}, e -> e.i = k), 0).v, CAST(0 AS FLOAT)))"


def _cast(v, *_):
    return f"CAST({v} AS ARRAY<FLOAT>)"


def _zip(op):
    return lambda a, b: _same(a, b, f"zip_with({a}, {b}, (x, y) -> CAST(x {op} y AS FLOAT))")


#: A number as text, whole ones without a point.
_NUMBER = "regexp_replace(CAST(x AS STRING), '\\\\.0$', '')"
MACROS = {
    "l2_distance": _l2,
    "inner_product": lambda a, b: _same(a, b, _dot(a, b)),
    "negative_inner_product": lambda a, b: f"(-{_same(a, b, _dot(a, b))})",
    "cosine_distance": lambda a, b: _same(a, b, f"(1 - {_dot(a, b)} / nullif({_norm(a)} * {_norm(b)}, 0))"),
    "l1_distance": _l1,
    "manhattan_distance": _l1,
    "hamming_distance": lambda a, b: f"CAST({_bits(a, b, 'x <> y')} AS DOUBLE)",
    "jaccard_distance": lambda a, b: f"(1 - coalesce({_bits(a, b, 'x = 1 AND y = 1')} / nullif({_bits(a, b, 'x = 1 OR y = 1')}, 0), 0D))",
    "vector_dims": lambda v: f"size({v})",
    "l2_norm": _norm,
    "vector_norm": _norm,
    "l2_normalize": lambda v: f"transform({v}, __x -> CAST(coalesce(__x / nullif({_norm(v)}, 0), __x) AS FLOAT))",
    "subvector": lambda v, s, n: f"slice({v}, {s}, {n})",
    "binary_quantize": lambda v, *_: f"array_join(transform({v}, x -> CASE WHEN x > 0 THEN '1' ELSE '0' END), '')",
    "vector_in": _parse,
    "halfvec_in": _parse,
    "sparsevec_in": _sparse,
    **{k: (lambda v: f"concat('[', array_join(transform({v}, x -> {_NUMBER}), ','), ']')") for k in ("vector_out", "halfvec_out")},
    "sparsevec_out": lambda v: f"concat('{{', array_join(filter(transform({v}, (x, i) -> CASE WHEN x <> 0 THEN concat(i + 1, ':', {_NUMBER}) END), e -> e IS NOT NULL), ','), '}}/', size({v}))",
    **{k: _cast for k in ("array_to_vector", "halfvec_to_vector", "sparsevec_to_vector", "vector_to_float4", "halfvec_to_float4", "array_to_halfvec", "vector_to_halfvec", "sparsevec_to_halfvec", "vector_to_sparsevec", "halfvec_to_sparsevec", "array_to_sparsevec")},
    **{f"{k}_{n}": _zip(o) for k in ("vector", "halfvec") for n, o in (("add", "+"), ("sub", "-"), ("mul", "*"))},
    **{f"{k}_concat": (lambda a, b: f"concat({a}, {b})") for k in ("vector", "halfvec")},
}
