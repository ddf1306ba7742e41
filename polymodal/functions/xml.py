"""XML as text."""

from __future__ import annotations

_ESC = "replace(replace(replace(CAST({0} AS STRING), '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
MACROS = {
    "xmlelement": lambda name, *body: f"concat('<', {_n(name)}, '>', {', '.join(_ESC.format(b) for b in body) or chr(39) * 2}, '</', {_n(name)}, '>')",
    "xmlforest": lambda *cols: f"concat({', '.join(_tag(c) for c in cols)})",
    "xmlcomment": lambda s: f"concat('<!--', {s}, '-->')",
    "xmlconcat": lambda *a: f"concat_ws('', {', '.join(a)})",
    "xmlpi": lambda name, body="''": f"concat('<?', {_n(name)}, ' ', {body}, '?>')",
    "xmlroot": lambda x, *_: f"concat('<?xml version=\"1.0\"?>', {x})",
    "xmlparse": lambda x: x,
    "xmlserialize": lambda x: x,
    "xmlagg": lambda x: f"array_join(collect_list({x}), '')",
    "xpath": lambda p, x, *_: f"xpath({x}, {p})",
    "xpath_exists": lambda p, x, *_: f"(size(xpath({x}, {p})) > 0)",
    "xmlexists": lambda p, x, *_: f"(size(xpath({x}, {p})) > 0)",
    "xml_is_well_formed_document": lambda x: f"pm_xml_ok({x})",
    **{k: (lambda x: f"pm_xml_ok(concat('<x>', regexp_replace({x}, '^\\\\s*<[?]xml[^>]*>', ''), '</x>'))") for k in ("xml_is_well_formed", "xml_is_well_formed_content")},
}


def _n(name: str) -> str:
    return name if name.startswith("'") else f"'{name.lower().removeprefix('name ')}'"


def _tag(c: str) -> str:
    value, _, name = c.partition(" AS ")
    name = name or value
    return f"concat('<{name}>', {_ESC.format(value)}, '</{name}>')"


def udfs():
    from ._udf import elementwise

    def ok(x):
        import xml.etree.ElementTree as E

        try:
            E.fromstring(x)
        except E.ParseError:
            return False
        return True

    return {"pm_xml_ok": elementwise(ok, "boolean")}
