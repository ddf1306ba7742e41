"""What a statement means by the types of its operands, which its text does not show.

The dialect truncates the quotient of two integers, rounds when a fraction becomes an integer, counts days between two dates, appends to arrays with ``||`` and
reads a range's ends with lower() and upper(). Catalyst analyses the statement first; where its types ask for it, the operator is
rewritten at the place in the text that the analysed node, or the analyser's complaint, points at, and the statement is analysed again.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

#: Marks the statement's own division and minus signs and casts among those that functions expand to.
MARK = "/*u*/"
_INTEGRAL = ("tinyint", "smallint", "int", "bigint")
#: What marks in the text ask for, and how such nodes show.
_ASKED = ((f"/ {MARK}", " / "), (f"- {MARK}", " - "), (f" {MARK})", "cast("))


def sql(spark: SparkSession, text: str) -> DataFrame:
    while True:
        try:
            df = spark.sql(text)
        except AnalysisException as e:
            better = _mended(text, e)
            if better is None:
                raise
            text = better
            continue
        shown = tuple(x for mark, x in _ASKED if mark in text)
        if not shown:
            return df
        edits = set(_edits(df._jdf.queryExecution().analyzed(), text, (*shown, "subquery")))
        # the innermost now; those around them get their turn with the types that come of it
        inner = [e for e in edits if not any(o != e and e[0] <= o[0] and o[1] <= e[1] for o in edits)]
        if not inner:
            return df
        for start, end, new in sorted(inner, reverse=True):
            text = text[:start] + new + text[end:]


def _top_level(text: str, sign: str) -> int:
    """The last place of a sign outside brackets and literals, or -1."""
    depth, i, found = 0, 0, -1
    while i < len(text):
        c = text[i]
        if c in "'`":
            i += 1
            while i < len(text) and text[i] != c:
                i += 1 + (text[i] == "\\")
        elif c in "([{":
            depth += 1
        elif c in ")]}":
            depth -= 1
        elif not depth and text.startswith(sign, i):
            found = i
        i += 1
    return found


def _items(s) -> Iterator:
    for i in range(s.size()):
        yield s.apply(i)


def _edits(plan, text: str, marks: tuple[str, ...]) -> Iterator[tuple[int, int, str]]:
    """(from, to, new text) for each node whose types the dialect reads differently."""
    for e in _items(plan.expressions()):
        yield from _expression_edits(e, text, marks)
    for p in _items(plan.children()):
        yield from _edits(p, text, marks)


def _expression_edits(e, text: str, marks: tuple[str, ...]) -> Iterator[tuple[int, int, str]]:
    shown = e.toString()
    if not any(x in shown for x in marks):
        return
    kind, origin = e.getClass().getSimpleName(), e.origin()
    if kind in ("Divide", "SubtractDates", "Cast") and origin.sqlText().isDefined() and origin.sqlText().get() == text and origin.startIndex().isDefined():
        a, b = origin.startIndex().get(), origin.stopIndex().get() + 1
        new = _rewritten(kind, e, text[a:b])
        if new:
            yield a, b, new
    for c in _items(e.children()):
        yield from _expression_edits(c, text, marks)
    if kind in ("ScalarSubquery", "Exists", "ListQuery", "LateralSubquery"):
        yield from _edits(e.plan(), text, marks)


def _rewritten(kind: str, e, part: str) -> str | None:
    if kind == "Divide":
        sign = f"/ {MARK}"
        k = _top_level(part, sign)
        whole = all(c.getClass().getSimpleName() == "Cast" and c.child().dataType().simpleString() in _INTEGRAL for c in (e.left(), e.right()))
        return f"{part[:k]}div{part[k + len(sign) :]}" if whole and k > 0 else None
    if kind == "SubtractDates":
        sign = f"- {MARK}"
        k = _top_level(part, sign)
        return f"datediff({part[:k].strip()}, {part[k + len(sign) :].strip()})" if k > 0 else None
    given = e.child().dataType().simpleString()
    if e.dataType().simpleString() in _INTEGRAL and part.startswith("CAST(") and part.endswith(f"{MARK})") and e.child().getClass().getSimpleName() not in ("Round", "Rint"):
        k = _top_level(part[5:-1], " AS ")
        if given.startswith("decimal"):
            return f"CAST(round({part[5 : 5 + k]}){part[5 + k :]}"
        if given in ("double", "float"):
            return f"CAST(rint({part[5 : 5 + k]}){part[5 + k :]}"
    return None


def _mended(text: str, e: AnalysisException) -> str | None:
    """The text with the operator that the analyser refuses in the form that its operands ask for."""
    where, about = e.getQueryContext(), e.getMessageParameters() or {}
    if not where or not e.getCondition() or not e.getCondition().startswith("DATATYPE_MISMATCH"):
        return None
    a, b = where[0].startIndex(), where[0].stopIndex() + 1
    part = text[a:b]
    if about.get("functionName") == "`concat`" and (k := _top_level(part, "||")) > 0:
        left, right = part[:k].strip(), part[k + 2 :].strip()
        new = f"array_append({left}, {right})" if about.get("dataType", "").startswith('("ARRAY') else f"array_prepend({right}, {left})"
    elif (m := re.match(r"(?is)(lower|upper)\((.*)\)$", part)) and "STRUCT" in about.get("inputType", ""):
        new = f"({m[2]}).{m[1].lower()}"
    else:
        return None
    return text[:a] + new + text[b:]
