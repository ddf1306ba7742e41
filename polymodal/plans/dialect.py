"""Rewrites PostgreSQL-dialect SQL text to Spark SQL text.

Text becomes tokens, tokens a tree of bracketed groups, and each level of the tree is rewritten on its own: casts and subscripts bind to the atom before
them, the dialect's own operators to the operands between weaker tokens, function calls expand by the macro tables of
``polymodal.functions``. What both dialects share passes through, so Catalyst sees one plain query; nothing is executed here.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from ..functions import MACROS
from ..functions.json import _texts as texts
from .typed import MARK

_TOKEN = re.compile(
    r"""(?P<space>\s+|--[^\n]*|/\*.*?\*/)|(?P<estr>[eE]'(?:[^'\\]|\\.|'')*')|(?P<str>'(?:[^']|'')*')|(?P<dollar>\$(?P<tag>\w*)\$.*?\$(?P=tag)\$)|(?P<qid>"(?:[^"]|"")*")|(?P<back>`[^`]*`)
    |(?P<num>\d+\.\d+(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?|\d+(?:[eE][+-]?\d+)?)|(?P<id>[^\W\d][\w$]*)
    |(?P<op>::|<->|<=>|<\#>|<\+>|<~>|<%>|->>|->|\#>>|\#>|\#-|@>|<@|\?\||\?&|\?|&&|@@|@\?|!~\*|!~|~\*|~|\|\||<=|>=|<>|!=|=>|<<|>>|[-+*/%^&|\#=<>.,;:()\[\]{}])""",
    re.X | re.S,
)

#: Words that end an operand.
_STOP = frozenset(
    """SELECT FROM WHERE GROUP BY HAVING ORDER LIMIT OFFSET FETCH UNION INTERSECT EXCEPT ALL DISTINCT AS ON USING JOIN LEFT RIGHT FULL INNER OUTER CROSS NATURAL LATERAL AND OR NOT IN IS LIKE ILIKE
    BETWEEN SIMILAR CASE WHEN THEN ELSE END ASC DESC NULLS WITH RECURSIVE OVER PARTITION ROWS RANGE WINDOW FILTER WITHIN VALUES SET RETURNING SYMMETRIC ANY SOME EXISTS ESCAPE TO ISNULL NOTNULL OVERLAPS INTO XOR""".split()
)
_COMPARE = frozenset("= <> != < <= > >= , ;".split())

_TYPES = {
    "text": "string", "varchar": "string", "name": "string", "bpchar": "string", "uuid": "string", "json": "string", "jsonb": "string", "tsvector": "string", "tsquery": "string", "inet": "string", "cidr": "string", "macaddr": "string", "xml": "string",
    "int2": "smallint", "int4": "int", "integer": "int", "int8": "bigint", "float4": "float", "real": "float", "float8": "double", "bool": "boolean", "bytea": "binary", "numeric": "decimal", "money": "decimal(19,2)",
    "timestamptz": "timestamp", "timestamp": "timestamp_ntz", "serial": "int", "bigserial": "bigint", "vector": "array<float>", "halfvec": "array<float>", "sparsevec": "array<float>", "regclass": "string", "oid": "bigint",
}


@dataclass
class Tok:
    kind: str
    text: str

    def up(self) -> str:
        return self.text.upper() if self.kind == "id" else self.text


@dataclass
class Group:
    open: str
    items: list

    kind = "group"

    def up(self) -> str:
        return self.open


def tokenize(text: str) -> list[Tok]:
    out, at = [], 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise ValueError(f"unexpected character {text[at]!r} at {at}")
        at, kind = m.end(), m.lastgroup
        if m.group("space"):
            continue
        if m.group("dollar"):
            tag = len(m.group("tag")) + 2
            out.append(Tok("str", _quote(m.group("dollar")[tag:-tag])))
        elif m.group("estr"):
            out.append(Tok("str", _quote(m.group("estr")[2:-1].replace("''", "'").encode().decode("unicode_escape").encode("latin-1", "backslashreplace").decode("utf-8", "replace"))))
        elif m.group("str"):
            out.append(Tok("str", _quote(m.group("str")[1:-1].replace("''", "'"))))
        elif m.group("qid"):
            out.append(Tok("qid", "`" + m.group("qid")[1:-1].replace('""', '"').replace("`", "``") + "`"))
        elif kind == "back":
            out.append(Tok("qid", m.group()))
        else:
            out.append(Tok(kind, m.group()))
    return out


def _quote(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _unquote(s: str) -> str:
    return s[1:-1].replace("\\'", "'").replace("\\\\", "\\")


def tree(tokens: list[Tok]) -> list:
    stack: list[list] = [[]]
    opened: list[str] = []
    for t in tokens:
        if t.kind == "op" and t.text in "([{":
            opened.append(t.text)
            stack.append([])
        elif t.kind == "op" and t.text in ")]}":
            if not opened or {"(": ")", "[": "]", "{": "}"}[opened[-1]] != t.text:
                raise ValueError(f"unbalanced {t.text}")
            g = Group(opened.pop(), stack.pop())
            stack[-1].append(g)
        else:
            stack[-1].append(t)
    if opened:
        raise ValueError(f"unbalanced {opened[-1]}")
    return stack[0]


def split(items: list, sep: str = ",") -> list[list]:
    out: list[list] = [[]]
    for x in items:
        if isinstance(x, Tok) and x.up() == sep:
            out.append([])
        else:
            out[-1].append(x)
    return out if out != [[]] else []


def _is(x, *words: str) -> bool:
    return isinstance(x, Tok) and x.kind in ("id", "op") and x.up() in words


def find(items: list, *words: str, start: int = 0) -> int:
    """Place of the words in a row at this level, or -1."""
    for i in range(start, len(items) - len(words) + 1):
        if all(_is(items[i + k], w) for k, w in enumerate(words)):
            return i
    return -1


# ---------------------------------------------------------------- statements


def rewrite(text: str) -> str:
    """A whole statement."""
    items = tree(tokenize(text))
    while items and _is(items[-1], ";"):
        items.pop()
    return statement(items)


def rewrite_expression(text: str) -> str:
    return expression(tree(tokenize(text)))


_SET_OPS = ("UNION", "INTERSECT", "EXCEPT")
_TAIL = (("ORDER", "BY"), ("LIMIT",), ("OFFSET",), ("FETCH",))


def statement(items: list) -> str:
    head = ""
    if items and _is(items[0], "WITH"):
        k = next((i for i, x in enumerate(items) if i and _is(x, "SELECT", "VALUES") or isinstance(x, Group) and i and not _is(items[i - 1], "AS", "MATERIALIZED") and items[i - 1].kind != "id"), len(items))
        ctes = [x for x in items[:k] if not _is(x, "MATERIALIZED")]
        head = _plain(ctes) + " "
        items = items[k:]
    body, tail = _cut_tail(items)
    parts, ops, last = [], [], 0
    for i, x in enumerate(body):
        if _is(x, *_SET_OPS):
            parts.append(body[last:i])
            last = i + 1
            op = x.up()
            if last < len(body) and _is(body[last], "ALL", "DISTINCT"):
                op += " " + body[last].up()
                last += 1
            ops.append(op)
    parts.append(body[last:])
    if len(parts) == 1 and find(parts[0], "DISTINCT", "ON") == 1:
        return head + _distinct_on(parts[0], tail)
    out = _select(parts[0])
    for op, p in zip(ops, parts[1:]):
        out += f" {op} {_select(p)}"
    return head + out + _tail(tail)


def _cut_tail(items: list) -> tuple[list, list]:
    at = [i for words in _TAIL if (i := find(items, *words)) >= 0]
    k = min(at, default=len(items))
    return items[:k], items[k:]


def _tail(items: list) -> str:
    out, i = "", 0
    while i < len(items):
        ends = [j for words in _TAIL if (j := find(items, *words, start=i + 1)) >= 0]
        j = min(ends, default=len(items))
        part = items[i:j]
        if _is(part[0], "ORDER"):
            out += " ORDER BY " + ", ".join(order_item(x) for x in split(part[2:]))
        elif _is(part[0], "LIMIT"):
            if not _is(part[1], "ALL"):
                out += " LIMIT " + expression(part[1:])
        elif _is(part[0], "OFFSET"):
            out += " OFFSET " + expression([x for x in part[1:] if not _is(x, "ROWS", "ROW")])
        else:
            n = [x for x in part[1:] if not _is(x, "FIRST", "NEXT", "ROW", "ROWS", "ONLY")]
            out += " LIMIT " + (expression(n) if n else "1")
        i = j
    limit, offset = re.search(r" LIMIT (?!.* LIMIT ).*?(?= OFFSET|$)", out), re.search(r" OFFSET .*?(?= LIMIT|$)", out)
    if limit and offset and limit.start() > offset.start():  # Spark wants LIMIT first
        out = out[: offset.start()] + limit[0] + offset[0]
    return out


def order_item(items: list) -> str:
    """With the dialect's default: nulls sort as the largest value."""
    nulls, items = "", list(items)
    k = find(items, "NULLS")
    if k >= 0:
        nulls, items = items[k + 1].up(), items[:k]
    desc = False
    if items and _is(items[-1], "ASC", "DESC"):
        desc = items.pop().up() == "DESC"
    elif (k := find(items, "USING")) >= 0:
        desc, items = _is(items[k + 1], ">", ">="), items[:k]
    return f"{expression(items)} {'DESC' if desc else 'ASC'} NULLS {nulls or ('FIRST' if desc else 'LAST')}"


def _select(items: list) -> str:
    if len(items) == 1 and isinstance(items[0], Group):
        return f"({statement(items[0].items)})"
    return _plain(items)


def _distinct_on(items: list, tail: list) -> str:
    keys, rest = split(items[3].items), items[4:]
    f = find(rest, "FROM")
    cols, source = rest[:f], rest[f:]
    k = find(tail, "ORDER", "BY")
    end = min([i for w in (("LIMIT",), ("OFFSET",), ("FETCH",)) if (i := find(tail, *w)) >= 0], default=len(tail))
    order = split(tail[2:end]) if k == 0 else []
    sort = [order_item(x) for x in order] or ["1"]
    hidden = []
    for n, o in enumerate(sort):
        m = re.match(r"(.*) (ASC|DESC) NULLS (FIRST|LAST)$", o, re.S)
        if m:
            hidden.append((f"{m[1]} AS __o{n}", f"__o{n} {m[2]} NULLS {m[3]}"))
    by = ", ".join(expression(x) for x in keys)
    extra = "".join(", " + a for a, _ in hidden)
    inner = f"SELECT {_plain(cols)}{extra}, row_number() OVER (PARTITION BY {by} ORDER BY {', '.join(sort)}) AS __rn {_plain(source)}"
    drop = ", ".join(["__rn", *(f"__o{n}" for n in range(len(hidden)))])
    last = " ORDER BY " + ", ".join(b for _, b in hidden) if hidden else ""
    return f"SELECT * EXCEPT ({drop}) FROM ({inner}) WHERE __rn = 1{last}{_tail(tail[end:])}"


_SRF = {"generate_series": "explode(sequence({}))", "unnest": "explode({})", "jsonb_array_elements": None, "regexp_split_to_table": None, "string_to_table": None, "json_object_keys": None, "jsonb_object_keys": None, "json_array_elements_text": None, "jsonb_array_elements_text": None, "json_array_elements": None, "generate_subscripts": None, "jsonb_each_text": None, "json_each_text": None, "jsonb_each": None, "json_each": None, "regexp_matches": None}


def _plain(items: list) -> str:
    """Everything else at a level: set-returning functions after FROM become derived tables, the rest are expressions."""
    out: list = []
    i, in_from = 0, False
    while i < len(items):
        x = items[i]
        if _is(x, "FROM", "JOIN", "LATERAL"):
            in_from = True
        elif _is(x, "WHERE", "SELECT", "ON", "GROUP", "HAVING"):
            in_from = False
        elif in_from and isinstance(x, Tok) and x.text.lower() in _SRF and i + 1 < len(items) and isinstance(items[i + 1], Group):
            text, used = _table_function(items[i:])
            out.append(Tok("raw", text))
            i += used
            continue
        out.append(x)
        i += 1
    return expression(out)


def _table_function(items: list) -> tuple[str, int]:
    name, args = items[0].text.lower(), [expression(a) for a in split(items[1].items)]
    used, alias, cols = 2, name, []
    ordinality = len(items) > 3 and _is(items[2], "WITH") and _is(items[3], "ORDINALITY")
    used += 2 * ordinality
    if used < len(items) and _is(items[used], "AS"):
        used += 1
    if used < len(items) and isinstance(items[used], Tok) and items[used].kind in ("id", "qid") and items[used].up() not in _STOP:
        alias, used = items[used].text, used + 1
        if used < len(items) and isinstance(items[used], Group):
            cols, used = [c[0].text for c in split(items[used].items)], used + 1
    array = MACROS[f"array_of:{name}"](*args) if f"array_of:{name}" in MACROS else args[0]
    if name.endswith(("_each", "_each_text")):
        cols = cols or ["key", "value"]
        return f"LATERAL (SELECT explode({array}) AS ({', '.join(cols)})) AS {alias}", used
    value = cols[0] if cols else alias
    if ordinality:
        return f"LATERAL (SELECT {value}, __p + 1 AS {cols[1] if len(cols) > 1 else 'ordinality'} FROM (SELECT posexplode({array}) AS (__p, {value}))) AS {alias}", used
    return f"LATERAL (SELECT explode({array}) AS {value}) AS {alias}", used


# ---------------------------------------------------------------- expressions

#: The dialect's own operators: how their operands become Spark SQL.
_INFIX = {
    "->": lambda a, b: f"pm_json_get({a}, {_key(b)})", "->>": lambda a, b: _json_text(a, b), "#>": lambda a, b: f"pm_json_path({a}, {texts(b)})", "#>>": lambda a, b: f"pm_json_path_text({a}, {texts(b)})", "#-": lambda a, b: f"pm_json_delete_path({a}, {texts(b)})",
    "@>": lambda a, b: MACROS["contains"](a, b), "<@": lambda a, b: MACROS["contains"](b, a), "&&": lambda a, b: MACROS["overlap"](a, b),
    "?": lambda a, b: f"coalesce(array_contains(json_object_keys({a}), {b}), false)", "?|": lambda a, b: f"coalesce(arrays_overlap(json_object_keys({a}), {b}), false)", "?&": lambda a, b: f"coalesce(size(array_except({b}, json_object_keys({a}))) = 0, false)",
    "@@": lambda a, b: f"pm_ts_match({a}, {b})", "@?": lambda a, b: MACROS["jsonb_path_exists"](a, b),
    "~": lambda a, b: f"({a} RLIKE {b})", "~*": lambda a, b: f"({a} RLIKE concat('(?i)', {b}))", "!~": lambda a, b: f"(NOT {a} RLIKE {b})", "!~*": lambda a, b: f"(NOT {a} RLIKE concat('(?i)', {b}))",
    "<->": lambda a, b: MACROS["l2_distance"](a, b), "<=>": lambda a, b: MACROS["cosine_distance"](a, b), "<#>": lambda a, b: MACROS["negative_inner_product"](a, b), "<+>": lambda a, b: MACROS["l1_distance"](a, b), "<~>": lambda a, b: MACROS["hamming_distance"](a, b), "<%>": lambda a, b: MACROS["jaccard_distance"](a, b),
    "<<": lambda a, b: f"shiftleft({a}, {b})", ">>": lambda a, b: f"shiftright({a}, {b})", "#": lambda a, b: f"({a} ^ {b})",
}


def _key(b: str) -> str:
    return b if b.startswith("'") else f"CAST({b} AS STRING)"


def _json_text(a: str, b: str) -> str:
    if b.startswith("'") and re.fullmatch(r"'\w+'", b):
        return f"get_json_object({a}, '$.{b[1:-1]}')"
    if re.fullmatch(r"\d+", b):
        return f"get_json_object({a}, '$[{b}]')"
    return f"pm_json_get_text({a}, {_key(b)})"


def expression(items: list) -> str:
    atoms = _atoms(items)
    atoms = _powers(atoms)
    atoms = _infix(atoms)
    atoms = _predicates(atoms)
    return " ".join(t for _, t in atoms).replace(" , ", ", ")


#: Functions that are called without brackets.
_BARE = {"localtime": lambda: MACROS["localtime"](), "localtimestamp": lambda: "localtimestamp()", "current_time": lambda: MACROS["current_time"](), "current_catalog": lambda: "current_catalog()"}


def _atoms(items: list) -> list[tuple[str, str]]:
    """(kind, text): atom for operands, word for keywords, op for operators."""
    out: list[tuple[str, str]] = []
    i = 0
    while i < len(items):
        x = items[i]
        if isinstance(x, Group):
            if x.open == "[":
                if out and out[-1][0] == "word" and out[-1][1].upper() == "ARRAY":
                    out[-1] = ("atom", _array(x))
                elif out and out[-1][0] == "atom":
                    out[-1] = ("atom", _subscript(out[-1][1], x))
                else:
                    out.append(("atom", _array(x)))
            elif x.open == "{":
                out.append(("atom", "{" + expression(x.items) + "}"))
            else:
                out.append(("atom", _paren(x)))
        elif x.kind == "raw":
            out.append(("word", x.text))
        elif x.kind in ("str", "num"):
            if x.kind == "str" and out and out[-1][0] == "atom" and out[-1][1].lower() in ("date", "timestamp", "interval", "timestamptz", "time", "json", "jsonb", "point", "box", "uuid"):
                out[-1] = ("atom", _typed(out[-1][1].lower(), x.text))
            else:
                out.append(("atom", x.text))
        elif x.kind in ("id", "qid"):
            if x.kind == "id" and x.up() == "ARRAY" and i + 1 < len(items) and isinstance(items[i + 1], Group) and items[i + 1].open == "(":
                out.append(("atom", f"(SELECT collect_list(__v) FROM ({statement(items[i + 1].items)}) AS __q(__v))"))
                i += 2
                continue
            if x.kind == "id" and (x.up() in _STOP or x.up() == "ARRAY") and not (i + 1 < len(items) and isinstance(items[i + 1], Group) and (x.up() in ("LEFT", "RIGHT", "RANGE") or x.up() == "OVERLAPS" and not (out and out[-1][0] == "atom"))):
                out.append(("word", x.text))
            elif x.kind == "id" and x.text.lower() in _BARE and not (i + 1 < len(items) and (isinstance(items[i + 1], Group) or _is(items[i + 1], "."))) and not (i and _is(items[i - 1], ".", "AS")):
                out.append(("atom", _BARE[x.text.lower()]()))
            else:
                text = x.text
                while i + 2 < len(items) and _is(items[i + 1], ".") and (items[i + 2].kind in ("id", "qid") or _is(items[i + 2], "*")):
                    text += "." + items[i + 2].text
                    i += 2
                if i + 1 < len(items) and isinstance(items[i + 1], Group) and items[i + 1].open == "(":
                    out.append(("atom", _call(text, items[i + 1])))
                    i += 1
                else:
                    out.append(("atom", text))
        elif x.text == "::":
            kind, used = _type(items[i + 1 :])
            out[-1] = ("atom", _cast(out[-1][1], kind))
            i += used
        else:
            out.append(("op", f"{x.text} {MARK}" if x.text == "/" or x.text == "-" and out and out[-1][0] == "atom" else x.text))
        i += 1
    return out


def _typed(kind: str, text: str) -> str:
    if kind in ("json", "jsonb", "uuid", "point", "box", "time"):
        return text
    return f"{'TIMESTAMP' if kind == 'timestamptz' else 'TIMESTAMP_NTZ' if kind == 'timestamp' else kind.upper()} {text}"


def _type(items: list) -> tuple[str, int]:
    """Spark's name of the type that begins here, and how many items it takes."""
    name, used = items[0].text.lower(), 1
    if name == "double" and len(items) > 1 and _is(items[1], "PRECISION"):
        used = 2
    elif name == "character" and len(items) > 1 and _is(items[1], "VARYING"):
        name, used = "varchar", 2
    kind = _TYPES.get(name, name)
    if used < len(items) and isinstance(items[used], Group) and items[used].open == "(":
        inner, used = expression(items[used].items), used + 1
        if kind == "decimal":
            kind = f"decimal({inner})"
    elif kind == "decimal":
        kind = "decimal(38,10)"
    if used + 2 < len(items) and _is(items[used], "WITH", "WITHOUT") and _is(items[used + 1], "TIME") and _is(items[used + 2], "ZONE"):
        kind, used = ("timestamp" if _is(items[used], "WITH") else "timestamp_ntz"), used + 3
    while used < len(items) and isinstance(items[used], Group) and items[used].open == "[":
        kind, used = f"array<{kind}>", used + 1
    return kind, used


def _cast(value: str, kind: str) -> str:
    if kind.startswith("array<") and value.startswith("'"):
        s = _unquote(value).strip()
        if s.startswith("{") and s.endswith("}") and "{" not in s[1:]:  # an array literal of the dialect
            items = [x.strip().strip('"') for x in s[1:-1].split(",") if x.strip()]
            return f"CAST(array({', '.join('NULL' if x == 'NULL' else _quote(x) for x in items)}) AS {kind})"
        return f"from_json('{s}', '{kind}')"
    mark = f" {MARK}" if kind in ("smallint", "int", "bigint", "tinyint") else ""
    return f"CAST({value} AS {kind}{mark})"


def _array(g: Group) -> str:
    return f"array({', '.join(expression(x) for x in split(g.items))})"


def _subscript(value: str, g: Group) -> str:
    """1-based; outside the array is NULL."""
    k = next((i for i, x in enumerate(g.items) if _is(x, ":")), -1)
    if k < 0:
        return f"get({value}, CAST({expression(g.items)} AS INT) - 1)"
    lo, hi = expression(g.items[:k]) or "1", expression(g.items[k + 1 :]) or f"size({value})"
    return f"slice({value}, greatest(CAST({lo} AS INT), 1), greatest(CAST({hi} AS INT) - greatest(CAST({lo} AS INT), 1) + 1, 0))"


def _paren(g: Group) -> str:
    if g.items and _is(g.items[0], "SELECT", "WITH", "VALUES"):
        return f"({statement(g.items)})"
    if find(g.items, "PARTITION", "BY") == 0 or find(g.items, "ORDER", "BY") >= 0:
        return f"({_window(g.items)})"
    return f"({_plain(g.items)})"


def _window(items: list) -> str:
    k = find(items, "ORDER", "BY")
    if k < 0:
        return expression(items)
    end = min([i for w in ("ROWS", "RANGE", "GROUPS") if (i := find(items, w, start=k)) >= 0], default=len(items))
    head = expression(items[:k])
    tail = expression(items[end:])
    return f"{head} ORDER BY {', '.join(order_item(x) for x in split(items[k + 2 : end]))} {tail}".strip()


def _call(name: str, g: Group) -> str:
    low = name.lower()
    items = g.items
    if low == "cast":
        k = find(items, "AS")
        return _cast(expression(items[:k]), _type(items[k + 1 :])[0])
    if items and _is(items[0], "SELECT", "WITH", "VALUES"):
        return f"{name} ({statement(items)})"
    if low in ("xmlparse", "xmlserialize") and items and _is(items[0], "DOCUMENT", "CONTENT"):
        k = find(items, "AS")
        return MACROS[low](expression(items[1 : k if k > 0 else len(items)]))
    if low in ("extract", "trim", "position", "overlay", "substring") and (words := [k for k, x in enumerate(items) if _is(x, "FROM", "IN", "PLACING", "FOR") or _is(x, "SIMILAR")]):
        return _worded(low, items, words)
    order = find(items, "ORDER", "BY")
    distinct = bool(items) and _is(items[0], "DISTINCT")
    if low in ("string_agg", "array_agg", "json_agg", "jsonb_agg", "listagg"):
        return _ordered_agg(low, items[distinct:order] if order >= 0 else items[distinct:], split(items[order + 2 :]) if order >= 0 else [], distinct)
    args = [expression(x) for x in split(items)]
    if low in MACROS and not distinct:
        return MACROS[low](*args)
    return f"{name}({_plain(items)})"


def _worded(low: str, items: list, words: list[int]) -> str:
    part = lambda a, b: expression(items[a:b])
    if low == "extract":
        return MACROS["date_part"](_quote(items[0].text.strip("'").lower()), part(words[0] + 1, len(items)))
    if low == "position":
        return f"locate({part(0, words[0])}, {part(words[0] + 1, len(items))})"
    if low == "trim":
        side = items[0].up() if _is(items[0], "BOTH", "LEADING", "TRAILING") else "BOTH"
        first = 1 if _is(items[0], "BOTH", "LEADING", "TRAILING") else 0
        chars = part(first, words[0])
        return f"trim({side} {chars} FROM {part(words[0] + 1, len(items))})" if chars else f"trim({side} FROM {part(words[0] + 1, len(items))})"
    if low == "overlay":
        ends = [*words[1:], len(items)]
        args = [part(0, words[0]), *(part(a + 1, b) for a, b in zip(words, ends))]
        return f"overlay({', '.join(args)})"
    by = {items[a].up(): part(a + 1, b) for a, b in zip(words, [*words[1:], len(items)])}
    if "FROM" in by and by["FROM"].startswith("'"):
        return f"nullif(regexp_substr({part(0, words[0])}, {by['FROM']}), '')"
    return MACROS["substring"](part(0, words[0]), by.get("FROM", "1"), *([by["FOR"]] if "FOR" in by else []))


def _ordered_agg(low: str, items: list, order: list[list], distinct: bool) -> str:
    args = [expression(x) for x in split(items)]
    if low in ("string_agg", "listagg"):
        sep = args[1] if len(args) > 1 else "''"
        by = ", ".join(order_item(x) for x in order)
        return f"listagg({'DISTINCT ' if distinct else ''}{args[0]}, {sep})" + (f" WITHIN GROUP (ORDER BY {by})" if by else "")
    x = args[0]
    if not order:
        rows = f"{'collect_set' if distinct else 'collect_list'}(struct({x} AS v))"
        rows = f"array_sort({rows})" if distinct else rows
    else:
        keys, compare = [], ""
        for n, o in enumerate(order):
            m = re.match(r"(.*) (ASC|DESC) NULLS (FIRST|LAST)$", order_item(o), re.S)
            keys.append(f"{m[1]} AS k{n}")
            sign, nulls = (-1 if m[2] == "ASC" else 1), (-1 if m[3] == "FIRST" else 1)
            compare += f" WHEN l.k{n} IS NULL AND r.k{n} IS NOT NULL THEN {nulls} WHEN r.k{n} IS NULL AND l.k{n} IS NOT NULL THEN {-nulls} WHEN l.k{n} < r.k{n} THEN {sign} WHEN l.k{n} > r.k{n} THEN {-sign}"
        rows = f"array_sort({'collect_set' if distinct else 'collect_list'}(struct({', '.join(keys)}, {x} AS v)), (l, r) -> CASE{compare} ELSE 0 END)"
    array = f"transform({rows}, x -> x.v)"
    if low == "array_agg":
        return f"(CASE WHEN count(1) = 0 THEN NULL ELSE {array} END)"
    return f"(CASE WHEN count(1) = 0 THEN NULL ELSE to_json({array}) END)"


def _span(atoms: list, at: int, step: int, weak) -> int:
    """The last place of the operand that goes on from ``at`` in direction step."""
    i = at
    while 0 <= i < len(atoms) and not weak(atoms[i]):
        i += step
    return i - step


def _powers(atoms: list) -> list:
    while any(a == ("op", "^") for a in atoms):
        k = atoms.index(("op", "^"))
        atoms[k - 1 : k + 2] = [("atom", f"power({atoms[k - 1][1]}, {atoms[k + 1][1]})")]
    return atoms


def _weak(a: tuple[str, str]) -> bool:
    return a[0] == "word" or a[0] == "op" and (a[1] in _COMPARE or a[1] in _INFIX)


def _infix(atoms: list) -> list:
    k = 0
    while k < len(atoms):
        kind, text = atoms[k]
        if kind == "op" and text in _INFIX:
            lo, hi = _span(atoms, k - 1, -1, _weak), _span(atoms, k + 1, 1, _weak)
            left, right = " ".join(t for _, t in atoms[lo:k]), " ".join(t for _, t in atoms[k + 1 : hi + 1])
            if left and right:
                atoms[lo : hi + 1] = [("atom", _INFIX[text](left, right))]
                k = lo
                continue
        k += 1
    return atoms


def _up(atoms: list, i: int) -> str:
    return atoms[i][1].upper() if 0 <= i < len(atoms) and atoms[i][0] == "word" else ""


def _predicates(atoms: list) -> list:
    logic = lambda a: a[0] == "word" and a[1].upper() not in ("NOT",) or a == ("op", ",")
    k = 0
    while k < len(atoms):
        w = _up(atoms, k)
        if w in ("ISNULL", "NOTNULL"):
            atoms[k] = ("word", "IS NULL" if w == "ISNULL" else "IS NOT NULL")
        elif w == "SIMILAR" and _up(atoms, k + 1) == "TO":
            from ..functions.text import similar_pattern

            pattern = atoms[k + 2][1]
            atoms[k : k + 3] = [("word", "RLIKE"), ("atom", _quote(similar_pattern(_unquote(pattern))))]
        elif w == "SYMMETRIC" and _up(atoms, k - 1) == "BETWEEN":
            mid = next(i for i in range(k, len(atoms)) if _up(atoms, i) == "AND")
            end = _span(atoms, mid + 1, 1, logic)
            a, b = (" ".join(t for _, t in atoms[i:j]) for i, j in ((k + 1, mid), (mid + 1, end + 1)))
            atoms[k : end + 1] = [("atom", f"least({a}, {b}) AND greatest({a}, {b})")]
        elif w == "OVERLAPS":
            (s1, e1), (s2, e2) = (x[1][1:-1].split(", ", 1) for x in (atoms[k - 1], atoms[k + 1]))
            atoms[k - 1 : k + 2] = [("atom", f"(least({s1}, {e1}) < greatest({s2}, {e2}) AND least({s2}, {e2}) < greatest({s1}, {e1}))")]
            k -= 1
        elif w in ("ANY", "SOME", "ALL") and k and atoms[k - 1][0] == "op" and k + 1 < len(atoms):
            op, right = atoms[k - 1][1], atoms[k + 1][1]
            lo = _span(atoms, k - 2, -1, lambda a: a[0] == "word" or a == ("op", ","))
            left = " ".join(t for _, t in atoms[lo : k - 1])
            if right.upper().startswith(("(SELECT", "(WITH")):
                test = f"EXISTS (SELECT 1 FROM {right} AS __q(__v) WHERE {left} {op} __v)" if w != "ALL" else f"NOT EXISTS (SELECT 1 FROM {right} AS __q(__v) WHERE NOT coalesce({left} {op} __v, false))"
            else:
                test = f"{'forall' if w == 'ALL' else 'exists'}({right}, __v -> {left} {op} __v)"
            atoms[lo : k + 2] = [("atom", f"({test})")]
            k = lo
        elif w == "XOR":
            lo, hi = _span(atoms, k - 1, -1, logic), _span(atoms, k + 1, 1, logic)
            a, b = " ".join(t for _, t in atoms[lo:k]), " ".join(t for _, t in atoms[k + 1 : hi + 1])
            atoms[lo : hi + 1] = [("atom", f"((({a}) OR ({b})) AND NOT (({a}) AND ({b})))")]
            k = lo
        elif atoms[k][0] == "atom" and atoms[k][1].upper() == "AT" and k + 3 < len(atoms) and atoms[k + 1][1].upper() == "TIME" and atoms[k + 2][1].upper() == "ZONE":
            atoms[k - 1 : k + 4] = [("atom", MACROS["timezone"](atoms[k + 3][1], atoms[k - 1][1]))]
            k -= 1
        elif atoms[k][0] == "atom" and atoms[k][1].upper() == "COLLATE":
            del atoms[k : k + 2]
            continue
        elif atoms[k][0] == "atom" and atoms[k][1].upper() in ("JSON",) and _up(atoms, k - 1) in ("IS", "NOT"):
            negated = _up(atoms, k - 1) == "NOT"
            end, form = k, ""
            while end + 1 < len(atoms) and atoms[end + 1][0] == "atom" and atoms[end + 1][1].upper() in ("VALUE", "OBJECT", "ARRAY", "SCALAR"):
                form, end = atoms[end + 1][1].upper(), end + 1
            if end + 1 < len(atoms) and _up(atoms, end + 1) == "ARRAY":
                form, end = "ARRAY", end + 1
            first = k - 1 - negated
            lo = _span(atoms, first - 1, -1, logic)
            test = MACROS["is_json"](" ".join(t for _, t in atoms[lo:first]), form)
            atoms[lo : end + 1] = [("atom", f"(NOT {test})" if negated else test)]
            k = lo
        k += 1
    return atoms
