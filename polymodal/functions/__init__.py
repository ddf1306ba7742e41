"""Scalar functions of the PostgreSQL dialect and of the graph language.

MACROS maps a lower-case name to a function from argument texts (Spark SQL expressions) to one Spark SQL expression, so most of the library is
built-in JVM expressions that Catalyst folds and pushes down. Names that mean the same in Spark SQL need no entry. What built-ins can't express is an
Arrow UDF named ``pm_*``; register() makes these known to a session.
"""

from __future__ import annotations

from . import arrays, casts, datetime, fulltext, geometry, json, math, network, ranges, text, vector, xml

_MODULES = (text, math, vector, datetime, arrays, json, ranges, casts, fulltext, network, geometry, xml)

MACROS: dict = {}
for _m in _MODULES:
    MACROS.update(_m.MACROS)


def register(spark) -> None:
    """Registers the Arrow UDFs of all families in a session."""
    for m in _MODULES:
        for name, udf in getattr(m, "udfs", dict)().items():
            spark.udf.register(name, udf)


def supported() -> list[str]:
    """The dialect's names that expand here; all other names go to Spark as they are."""
    return sorted(k for k in MACROS if ":" not in k)
