"""Points as struct(x, y); boxes, segments and circles as structs of these; paths and polygons as arrays of points."""

from __future__ import annotations

_DIST = "sqrt(power({a}.x - {b}.x, 2) + power({a}.y - {b}.y, 2))"
MACROS = {
    "point": lambda x, y: f"struct(CAST({x} AS DOUBLE) AS x, CAST({y} AS DOUBLE) AS y)",
    "box": lambda a, b: f"struct(struct(greatest({a}.x, {b}.x) AS x, greatest({a}.y, {b}.y) AS y) AS high, struct(least({a}.x, {b}.x) AS x, least({a}.y, {b}.y) AS y) AS low)",
    "lseg": lambda a, b: f"struct({a} AS p1, {b} AS p2)",
    "line": lambda a, b: f"struct({a} AS p1, {b} AS p2)",
    "circle": lambda c, r: f"struct({c} AS center, CAST({r} AS DOUBLE) AS radius)",
    "path": lambda a: a,
    "polygon": lambda a: a,
    "radius": lambda c: f"{c}.radius",
    "diameter": lambda c: f"(2 * {c}.radius)",
    "circle_center": lambda c: f"{c}.center",
    "center": lambda b: f"struct(({b}.high.x + {b}.low.x) / 2 AS x, ({b}.high.y + {b}.low.y) / 2 AS y)",
    "height": lambda b: f"({b}.high.y - {b}.low.y)",
    "width": lambda b: f"({b}.high.x - {b}.low.x)",
    "area": lambda b: f"(({b}.high.x - {b}.low.x) * ({b}.high.y - {b}.low.y))",
    "diagonal": lambda b: f"struct({b}.high AS p1, {b}.low AS p2)",
    "bound_box": lambda a, b: f"struct(struct(greatest({a}.high.x, {b}.high.x) AS x, greatest({a}.high.y, {b}.high.y) AS y) AS high, struct(least({a}.low.x, {b}.low.x) AS x, least({a}.low.y, {b}.low.y) AS y) AS low)",
    "npoints": lambda p: f"size({p})",
    "slope": lambda a, b: f"(({b}.y - {a}.y) / nullif({b}.x - {a}.x, 0))",
    "ishorizontal": lambda a, b: f"({a}.y = {b}.y)",
    "isvertical": lambda a, b: f"({a}.x = {b}.x)",
    "isclosed": lambda p: f"(get({p}, 0) = try_element_at({p}, -1))",
    "isopen": lambda p: f"(get({p}, 0) <> try_element_at({p}, -1))",
    "pclose": lambda p: f"(CASE WHEN get({p}, 0) = try_element_at({p}, -1) THEN {p} ELSE concat({p}, array(get({p}, 0))) END)",
    "popen": lambda p: f"(CASE WHEN size({p}) > 1 AND get({p}, 0) = try_element_at({p}, -1) THEN slice({p}, 1, size({p}) - 1) ELSE {p} END)",
    "point_distance": lambda a, b: _DIST.format(a=a, b=b),
}
