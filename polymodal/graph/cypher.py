"""Graph queries as DataFrame plans.

Clauses run in order over a table of bindings, one column a variable. A pattern is a chain of equi-joins with the labels' tables, so Catalyst prunes
columns, pushes property filters into scans and picks the joins. Expressions are rewritten to Spark SQL.
"""

from __future__ import annotations

import itertools
import re
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.recursive import cut
from ..plans import dialect
from ..plans.dialect import Group, Tok, find, split

#: Levels of a search after which those before are written together, so that plans stay small.
COMPACT = 16
AGGREGATES = frozenset("count sum avg min max collect stdev stdevp stddev stddev_samp stddev_pop percentilecont percentiledisc any_value bool_and bool_or variance var_samp var_pop string_agg".split())
_CLAUSES = (("OPTIONAL", "MATCH"), ("MATCH",), ("UNWIND",), ("WITH",), ("RETURN",), ("CALL",), ("WHERE",), ("ORDER", "BY"), ("SKIP",), ("LIMIT",), ("CREATE",), ("MERGE",), ("SET",), ("DETACH", "DELETE"), ("DELETE",), ("REMOVE",), ("YIELD",))

dialect._INFIX |= {
    "@starts": lambda a, b: f"startswith({a}, {b})", "@ends": lambda a, b: f"endswith({a}, {b})", "@has": lambda a, b: f"contains({a}, {b})", "@in": lambda a, b: f"array_contains({b}, {a})", "@match": lambda a, b: f"({a} RLIKE concat('^(?:', {b}, ')$'))",
}


def parse(text: str) -> list:
    out, quote = "", None
    i = 0
    while i < len(text):  # arrows without brackets, before -- could be a comment
        c = text[i]
        if quote:
            out += c
            if c == "\\" and quote == '"':
                i += 1
                out += text[i]
            quote = None if c == quote else quote
        elif c in "'\"":
            quote = c
            out += c
        elif text.startswith("-->", i):
            out, i = out + "-[]->", i + 2
        elif text.startswith("<--", i):
            out, i = out + "<-[]-", i + 2
        elif text.startswith("--", i) and out.rstrip().endswith(")"):
            out, i = out + "-[]-", i + 1
        else:
            out += c
        i += 1
    out = re.sub(r'"((?:[^"\\]|\\.)*)"', lambda m: "'" + m[1].replace("'", "''") + "'", out)
    return dialect.tree(dialect.tokenize(out))


# ------------------------------------------------------------- expressions


def expr(items: list, bound: dict | None = None) -> str:
    return dialect.expression(_prepare(items, bound or {}))


def _raw(text: str) -> Group:
    """A finished expression as one atom."""
    return Group("(", [Tok("num", text)])


_ACCESS = {"id": "{0}.__id", "type": "{0}.__type", "labels": "array({0}.__label)", "startnode": "{0}.__src", "endnode": "{0}.__dst", "nodes": "{0}.nodes", "relationships": "{0}.rels", "rels": "{0}.rels", "properties": "to_json({0})"}
_AGG_NAMES = {"stdev": "stddev_samp", "stdevp": "stddev_pop", "collect": "collect_list"}


def _prepare(items: list, bound: dict) -> list:
    out: list = []
    i = 0
    while i < len(items):
        x = items[i]
        nxt = items[i + 1] if i + 1 < len(items) else None
        if isinstance(x, Group):
            if x.open == "{" and out and isinstance(out[-1], Tok) and out[-1].text in bound and all(dialect._is(q[0], ".") or len(q) > 2 for q in split(x.items)):
                v = out.pop().text  # a map of some of a variable's properties
                pairs = [f"'{q[1].text}', {v}.{q[1].text}" if dialect._is(q[0], ".") else f"'{q[0].text}', {expr(q[2:], bound)}" for q in split(x.items)]
                out.append(_raw(f"named_struct({', '.join(pairs)})"))
            elif x.open == "{":
                pairs = [f"'{p[0].text.strip('`')}', {expr(p[2:], bound)}" for p in split(x.items)]
                out.append(_raw(f"named_struct({', '.join(pairs)})" if pairs else "map()"))
            elif x.open == "[":
                k, bar = find(x.items, "IN"), find(x.items, "|")
                if k == 1 and (bar > 0 or find(x.items, "WHERE") > 0 or len(split(x.items)) == 1 and isinstance(x.items[0], Tok) and x.items[0].kind == "id" and k == 1):
                    w = find(x.items, "WHERE")
                    v = x.items[0].text
                    rows = expr(x.items[2 : min(j for j in (w, bar, len(x.items)) if j >= 0)], bound)
                    if w > 0:
                        rows = f"filter({rows}, {v} -> {expr(x.items[w + 1 : bar if bar > 0 else None], bound)})"
                    if bar > 0:
                        rows = f"transform({rows}, {v} -> {expr(x.items[bar + 1 :], bound)})"
                    out.append(_raw(rows))
                elif out and (isinstance(out[-1], Group) or out[-1].kind in ("id", "qid")) and not (isinstance(out[-1], Tok) and out[-1].up() in dialect._STOP):
                    dots = next((j for j in range(len(x.items)) if isinstance(x.items[j], Tok) and x.items[j].text == "."), -1)
                    base = dialect.expression(_operand(out))
                    if dots >= 0:
                        text = "".join(t.text for t in x.items)
                        lo, hi = text.split("..")
                        out.append(_raw(f"slice({base}, {int(lo or 0) + 1}, greatest({hi or f'size({base})'} - {int(lo or 0)}, 0))"))
                    else:
                        at = expr(x.items, bound)
                        out.append(_raw(f"try_element_at({base}, CASE WHEN {at} < 0 THEN {at} ELSE {at} + 1 END)"))
                else:
                    out.append(_raw(f"array({', '.join(expr(p, bound) for p in split(x.items))})"))
            else:
                out.append(Group("(", _prepare(x.items, bound)))
        elif x.kind == "id" and isinstance(nxt, Group) and nxt.open == "(" and x.up() not in dialect._STOP | {"ANY", "ALL", "EXISTS"} or x.kind == "id" and isinstance(nxt, Group) and nxt.open == "(" and x.up() in ("ANY", "ALL", "NONE", "SINGLE", "EXISTS", "LEFT", "RIGHT", "RANGE"):
            low = x.text.lower()
            k, w = find(nxt.items, "IN"), find(nxt.items, "WHERE")
            if low in ("any", "all", "none", "single") and k == 1 and w > 0:
                v, rows, test = nxt.items[0].text, expr(nxt.items[2:w], bound), expr(nxt.items[w + 1 :], bound)
                out.append(_raw({"any": f"exists({rows}, {v} -> {test})", "all": f"forall({rows}, {v} -> {test})", "none": f"NOT exists({rows}, {v} -> {test})", "single": f"size(filter({rows}, {v} -> {test})) = 1"}[low]))
            elif low == "exists":
                out.append(_raw(f"({expr(nxt.items, bound)} IS NOT NULL)"))
            elif low in _ACCESS and len(nxt.items) >= 1:
                out.append(_raw(_ACCESS[low].format(expr(nxt.items, bound))))
            elif low == "length" and len(nxt.items) == 1 and bound.get(nxt.items[0].text) == "path":
                out.append(_raw(f"size({nxt.items[0].text}.rels)"))
            elif low == "size" and len(nxt.items) == 1 and nxt.items[0].kind == "str":
                out.append(_raw(f"char_length({nxt.items[0].text})"))
            elif low == "count" and len(nxt.items) == 1 and isinstance(nxt.items[0], Tok) and nxt.items[0].text == "*":
                out.append(_raw("count(1)"))
            elif low in ("percentilecont", "percentiledisc"):
                a = [expr(p, bound) for p in split(nxt.items)]
                out.append(_raw(f"percentile_{low[10:]}({a[1]}) WITHIN GROUP (ORDER BY {a[0]})"))
            elif low == "keys" and len(nxt.items) == 1 and nxt.items[0].text in bound:
                out.append(_raw(f"json_object_keys(to_json({nxt.items[0].text}))"))
            else:
                distinct = bool(nxt.items) and dialect._is(nxt.items[0], "DISTINCT")
                inner = Group("(", [*nxt.items[:distinct], *_prepare(nxt.items[distinct:], bound)])
                out += [Tok("id", _AGG_NAMES.get(low, x.text)), inner]
            i += 1
        elif x.kind == "id" and isinstance(nxt, Tok) and nxt.text == ":" and i + 2 < len(items) and items[i + 2].kind in ("id", "qid") and x.text in bound:
            out.append(_raw(f"({x.text}.__label = '{items[i + 2].text.strip('`')}')"))
            i += 2
        elif dialect._is(x, "STARTS", "ENDS") and nxt is not None and dialect._is(nxt, "WITH"):
            out.append(Tok("op", "@starts" if x.up() == "STARTS" else "@ends"))
            i += 1
        elif dialect._is(x, "CONTAINS"):
            out.append(Tok("op", "@has"))
        elif dialect._is(x, "IN"):
            out.append(Tok("op", "@in"))
        elif isinstance(x, Tok) and x.text == "=" and isinstance(nxt, Tok) and nxt.text == "~":
            out.append(Tok("op", "@match"))
            i += 1
        else:
            out.append(x)
        i += 1
    return out


def _operand(out: list) -> list:
    """Takes the last postfix expression off."""
    parts = [out.pop()]
    if isinstance(parts[0], Group) and out and isinstance(out[-1], Tok) and out[-1].kind == "id" and out[-1].up() not in dialect._STOP:
        parts.insert(0, out.pop())
    while len(out) >= 2 and isinstance(out[-1], Tok) and out[-1].text == ".":
        parts[:0] = [out[-2], out[-1]]
        del out[-2:]
    return parts


def aggregated(items: list) -> bool:
    for k, x in enumerate(items):
        if isinstance(x, Group):
            if k and isinstance(items[k - 1], Tok) and items[k - 1].text.lower() in AGGREGATES and x.open == "(" or aggregated(x.items):
                return True
    return False


def _name(items: list) -> str:
    """The column name of an unnamed item: its text."""
    out = ""
    for x in items:
        t = f"{x.open}{_name(x.items)}{ {'(': ')', '[': ']', '{': '}'}[x.open] }".replace(" ", "") if isinstance(x, Group) else x.text
        out += t if not out or t in (".", ",", ")") or out.endswith(".") or isinstance(x, Group) else (" " + t if x.kind != "op" or t not in (".",) else t)
    return out


# ---------------------------------------------------------------- patterns


@dataclass
class Node:
    var: str
    labels: list[str] = field(default_factory=list)
    props: list = field(default_factory=list)


@dataclass
class Rel:
    var: str
    types: list[str] = field(default_factory=list)
    props: list = field(default_factory=list)
    direction: str = "out"
    hops: tuple[int, int | None] | None = None


class Query:
    def __init__(self, graph):
        self.graph, self.df, self.bound = graph, None, {}
        self.fresh = (f"__v{n}" for n in itertools.count())

    # -- parsing of patterns

    def node(self, g: Group) -> Node:
        brace = next((k for k, x in enumerate(g.items) if isinstance(x, Group) and x.open == "{"), len(g.items))
        head = g.items[:brace]
        named = head and isinstance(head[0], Tok) and head[0].kind in ("id", "qid")
        labels = [x.text.strip("`") for k, x in enumerate(head) if k > (0 if named else -1) and isinstance(x, Tok) and x.kind in ("id", "qid")]
        return Node(head[0].text if named else next(self.fresh), labels, g.items[brace].items if brace < len(g.items) else [])

    def rel(self, items: list, direction: str) -> Rel:
        brace = next((k for k, x in enumerate(items) if isinstance(x, Group)), len(items))
        star = next((k for k, x in enumerate(items) if isinstance(x, Tok) and x.text == "*"), brace)
        head = items[: min(star, brace)]
        named = head and isinstance(head[0], Tok) and head[0].kind in ("id", "qid")
        types = [x.text.strip("`") for k, x in enumerate(head) if k > (0 if named else -1) and isinstance(x, Tok) and x.kind in ("id", "qid")]
        hops = None
        if star < brace:
            m = re.fullmatch(r"\*(\d*)(\.\.)?(\d*)", "".join(x.text for x in items[star:brace]))
            lo = int(m[1]) if m[1] else 1
            hops = (lo, int(m[3]) if m[3] else None) if m[2] else (lo, lo) if m[1] else (1, None)
        return Rel(head[0].text if named else next(self.fresh), types, items[brace].items if brace < len(items) else [], direction, hops)

    def chain(self, items: list) -> tuple[list[Node], list[Rel]]:
        nodes, rels, i = [self.node(items[0])], [], 1
        while i < len(items):
            back = dialect._is(items[i], "<")
            i += back
            i += 1  # -
            inner = []
            if isinstance(items[i], Group) and items[i].open == "[":
                inner, i = items[i].items, i + 1
            ahead = items[i].text == "->"
            i += 1
            if not ahead and i < len(items) and dialect._is(items[i], ">"):
                ahead, i = True, i + 1
            rels.append(self.rel(inner, "in" if back and not ahead else "out" if ahead and not back else "both"))
            nodes.append(self.node(items[i]))
            i += 1
        return nodes, rels

    # -- evaluation of patterns

    def props(self, var: str, props: list) -> Column | None:
        out = None
        for p in split(props):
            one = F.expr(f"`{var}`.`{p[0].text.strip('`')}` = {expr(p[2:], self.bound)}")
            out = one if out is None else out & one
        return out

    def add_node(self, n: Node) -> None:
        if n.var in self.bound:
            test = self.props(n.var, n.props)
            for label in n.labels:
                one = F.lower(F.col(f"`{n.var}`.__label")).isin(*self.graph.same_nodes(label))
                test = one if test is None else test & one
            self.df = self.df if test is None else self.df.where(test)
            return
        s = self.labelled(n).select(F.struct("*").alias(n.var))
        self.df = s if self.df is None else self.df.crossJoin(s)
        self.bound[n.var] = "node"
        test = self.props(n.var, n.props)
        self.df = self.df if test is None else self.df.where(test)

    def labelled(self, n: Node) -> DataFrame:
        """Nodes that have all of the pattern's labels."""
        nodes = self.graph.node_table(n.labels[:1] or None)
        for label in n.labels[1:]:
            nodes = nodes.where(F.lower("__label").isin(*self.graph.same_nodes(label)))
        return nodes

    def edges(self, r: Rel) -> DataFrame:
        """(rel struct, from, from label, to, to label) in the pattern's direction."""
        e = self.graph.edge_table(r.types or None)
        base = e.select(F.struct("*").alias("__e"))
        test = None
        for p in split(r.props):
            one = F.expr(f"__e.`{p[0].text.strip('`')}` = {expr(p[2:], {})}")
            test = one if test is None else test & one
        base = base if test is None else base.where(test)
        ahead = base.select("__e", F.col("__e.__src").alias("__f"), F.col("__e.__sl").alias("__fl"), F.col("__e.__dst").alias("__t"), F.col("__e.__tl").alias("__tl"))
        behind = base.select("__e", F.col("__e.__dst").alias("__f"), F.col("__e.__tl").alias("__fl"), F.col("__e.__src").alias("__t"), F.col("__e.__sl").alias("__tl"))
        return ahead if r.direction == "out" else behind if r.direction == "in" else ahead.unionAll(behind.where("__f <> __t"))

    def expand(self, a: Node, r: Rel, b: Node) -> None:
        if r.hops is None:
            e = self.edges(r)
            at = F.col(f"`{a.var}`.__id")
            j = self.df.join(e, (at == F.col("__f")) & (F.col("__fl").isNull() | (F.col(f"`{a.var}`.__label") == F.col("__fl"))))
            kind = F.col("__e")
        else:
            e = self.trails(a, r)
            j = self.df.join(e, (F.col(f"`{a.var}`.__id") == F.col("__f")) & F.col(f"`{a.var}`.__label").eqNullSafe(F.col("__fl")))
            kind = F.col("__path")
        if b.var in self.bound:
            j = j.where((F.col(f"`{b.var}`.__id") == F.col("__t")) & (F.col("__tl").isNull() | (F.col(f"`{b.var}`.__label") == F.col("__tl"))))
            self.df = j.withColumn(r.var, kind).drop("__e", "__path", "__f", "__fl", "__t", "__tl")
            self.bound[r.var] = "rel" if r.hops is None else "rels"
            self.add_node(b)
            return
        n = self.labelled(b).select(F.struct("*").alias(b.var))
        j = j.join(n, (F.col(f"`{b.var}`.__id") == F.col("__t")) & (F.col("__tl").isNull() | (F.col(f"`{b.var}`.__label") == F.col("__tl"))))
        self.df = j.withColumn(r.var, kind).drop("__e", "__path", "__f", "__fl", "__t", "__tl")
        self.bound[b.var], self.bound[r.var] = "node", "rel" if r.hops is None else "rels"
        test = self.props(b.var, b.props)
        self.df = self.df if test is None else self.df.where(test)

    def trails(self, a: Node, r: Rel) -> DataFrame:
        """(__f, __fl, __t, __tl, __path): trails of lo..hi edges, no edge twice, from the nodes bound to a."""
        lo, hi = r.hops
        e = self.edges(r)
        hop = e.select(F.col("__e").alias("__n"), F.col("__f").alias("__hf"), F.col("__fl").alias("__hfl"), F.col("__t").alias("__ht"), F.col("__tl").alias("__htl"))
        starts = self.df.select(F.col(f"`{a.var}`.__id").alias("__f"), F.col(f"`{a.var}`.__label").alias("__fl")).distinct()
        now = starts.select("__f", "__fl", F.col("__f").alias("__t"), F.col("__fl").alias("__tl"), F.expr("slice(array(named_struct('x', 1)), 1, 0)").alias("__none"))
        empty = e.select(F.slice(F.array("__e"), 1, 0).alias("__path"))
        kind = empty.schema["__path"].dataType
        now = now.withColumn("__path", F.array().cast(kind)).drop("__none")
        out = now if lo == 0 else None
        for n in range(1, hi + 1) if hi is not None else itertools.count(1):  # without an upper bound until no trail goes on
            j = now.join(hop, (F.col("__t") == F.col("__hf")) & (F.col("__hfl").isNull() | F.col("__tl").isNull() | (F.col("__tl") == F.col("__hfl"))))
            if n > 1:
                j = j.where(~F.exists("__path", lambda p: p["__id"] == F.col("__n.__id")))
            now = j.select("__f", "__fl", F.col("__ht").alias("__t"), F.col("__htl").alias("__tl"), F.concat("__path", F.array("__n")).alias("__path"))
            if hi is None or n >= 3:
                now = cut(now)
                if now.isEmpty():
                    break
            if n >= lo:
                out = now if out is None else out.unionAll(now)
                if n % COMPACT == 0:
                    out = cut(out)
        return out if out is not None else now.limit(0)

    def shortest(self, a: Node, r: Rel, b: Node, every: bool) -> None:
        """Breadth-first from the nodes bound to a; a node is reached once a start (every: by all shortest paths)."""
        lo, hi = r.hops or (1, 1)
        e = self.edges(r)
        hop = e.select(F.col("__e").alias("__n"), F.col("__f").alias("__hf"), F.col("__t").alias("__ht"))
        if b.var not in self.bound:
            self.add_node(b)
        starts = self.df.select(F.col(f"`{a.var}`.__id").alias("__f")).distinct()
        kind = e.select(F.array("__e").alias("__path")).schema["__path"].dataType
        now = starts.select("__f", F.col("__f").alias("__t"), F.array().cast(kind).alias("__path"))
        seen, out = now.select("__f", "__t"), []
        for _ in range(hi) if hi is not None else itertools.count():
            j = now.join(hop, F.col("__t") == F.col("__hf")).select("__f", F.col("__ht").alias("__t"), F.concat("__path", F.array("__n")).alias("__path"))
            j = j.join(seen, ["__f", "__t"], "left_anti")
            if not every:
                j = j.groupBy("__f", "__t").agg(F.min_by("__path", F.transform("__path", lambda p: p["__id"])).alias("__path"))
            now = cut(j)
            if now.isEmpty():
                break
            out.append(now)
            seen = seen.unionAll(now.select("__f", "__t").distinct())
            if len(out) % COMPACT == 0:
                seen = cut(seen)
        found = out[0] if out else now.limit(0)
        for x in out[1:]:
            found = found.unionAll(x)
        self.df = self.df.join(found, (F.col(f"`{a.var}`.__id") == F.col("__f")) & (F.col(f"`{b.var}`.__id") == F.col("__t"))).withColumn(r.var, F.col("__path")).drop("__path", "__f", "__t")
        self.bound[r.var] = "rels"

    def pivot(self, nodes: list[Node]) -> int:
        """Where a chain begins: at a node that is bound, so nothing is multiplied out; else at one that its properties, or a label, narrow."""
        for wanted in (lambda n: n.var in self.bound, lambda n: n.props, lambda n: n.labels):
            for k, n in enumerate(nodes):
                if wanted(n):
                    return k
        return 0

    def match(self, items: list) -> None:
        used: list[Rel] = []
        for part in split(items):
            path = None
            if len(part) > 2 and isinstance(part[1], Tok) and part[1].text == "=":
                path, part = part[0].text, part[2:]
            short = None
            if isinstance(part[0], Tok) and part[0].text.lower() in ("shortestpath", "allshortestpaths"):
                short, part = part[0].text.lower(), part[1].items
            nodes, rels = self.chain(part)
            p = 0 if short else self.pivot(nodes)
            self.add_node(nodes[p])
            steps = list(zip(nodes, rels, nodes[1:]))
            for a, r, b in [*steps[p:], *((b, r, a) for a, r, b in reversed(steps[:p]))]:
                if short:
                    self.shortest(a, r, b, short.startswith("all"))
                elif any(x is r for x in rels[:p]):
                    self.expand(a, replace(r, direction={"out": "in", "in": "out"}.get(r.direction, r.direction)), b)
                    if r.hops is not None:  # walked from its end
                        self.df = self.df.withColumn(r.var, F.reverse(F.col(f"`{r.var}`")))
                else:
                    self.expand(a, r, b)
                for o in used:  # an edge is used once in a clause
                    if not set(o.types or "*").isdisjoint(r.types or "*") or not o.types or not r.types:
                        if o.hops is None and r.hops is None:
                            self.df = self.df.where(F.col(f"`{o.var}`.__id") != F.col(f"`{r.var}`.__id"))
                        elif o.hops is None or r.hops is None:
                            one, many = (o, r) if o.hops is None else (r, o)
                            self.df = self.df.where(~F.expr(f"exists(`{many.var}`, __p -> __p.__id = `{one.var}`.__id)"))
                used.append(r)
            if path:
                rel_ids = F.concat(*(F.transform(F.col(f"`{r.var}`"), lambda p: F.struct(p["__id"].alias("__id"), p["__type"].alias("__type"), p["__src"].alias("__src"), p["__dst"].alias("__dst"))) if r.hops else F.array(F.struct(*(F.col(f"`{r.var}`.{c}").alias(c) for c in ("__id", "__type", "__src", "__dst")))) for r in rels)) if rels else F.expr(f"slice(array(named_struct('__id', 0L, '__type', '', '__src', CAST(0 AS {self.graph.key_type()}), '__dst', CAST(0 AS {self.graph.key_type()}))), 1, 0)")
                start = F.col(f"`{nodes[0].var}`.__id")
                walk = F.aggregate(rel_ids, F.array(start), lambda acc, e: F.concat(acc, F.array(F.when(F.element_at(acc, -1) == e["__src"], e["__dst"]).otherwise(e["__src"]))))
                self.df = self.df.withColumn(path, F.struct(walk.alias("nodes"), rel_ids.alias("rels")))
                self.bound[path] = "path"

    # -- clauses

    def where(self, items: list) -> None:
        for conj in _conjuncts(items):
            negated = bool(conj) and dialect._is(conj[0], "NOT")
            body = conj[negated:]
            inner = body[0].items if len(body) == 1 and isinstance(body[0], Group) and body[0].open == "(" else body
            if len(inner) > 1 and dialect._is(inner[0], "EXISTS") and isinstance(inner[1], Group) and inner[1].open == "{":
                pattern = inner[1].items
                self.semi(pattern[1:] if dialect._is(pattern[0], "MATCH") else pattern, negated)
            elif _is_pattern(inner):
                self.semi(inner, negated)
            else:
                keep = self.df.columns
                test = expr(self.nested(conj), self.bound)
                self.df = self.df.where(F.expr(test)).select(*(F.col(f"`{c}`") for c in keep))

    def nested(self, items: list) -> list:
        """Pattern comprehensions, COUNT {...} and EXISTS {...} inside expressions become columns, each by one aggregation joined on the variables that it names."""
        out: list = []
        i = 0
        while i < len(items):
            x, nxt = items[i], items[i + 1] if i + 1 < len(items) else None
            bar = find(x.items, "|") if isinstance(x, Group) and x.open == "[" else -1
            w = find(x.items, "WHERE") if bar > 0 else -1
            cut_at = w if 0 < w < bar else bar
            if bar > 0 and _is_pattern(x.items[:cut_at]):
                out.append(self.attach(x.items[:cut_at], x.items[w + 1 : bar] if 0 < w < bar else [], x.items[bar + 1 :]))
            elif dialect._is(x, "COUNT", "EXISTS") and isinstance(nxt, Group) and nxt.open == "{":
                body = nxt.items[1:] if dialect._is(nxt.items[0], "MATCH") else nxt.items
                w = find(body, "WHERE")
                got = self.attach(body[:w] if w >= 0 else body, body[w + 1 :] if w >= 0 else [], None)
                out.append(got if x.up() == "COUNT" else Group("(", [got, Tok("op", ">"), Tok("num", "0")]))
                i += 1
            elif isinstance(x, Group):
                out.append(Group(x.open, self.nested(x.items)))
            else:
                out.append(x)
            i += 1
        return out

    def attach(self, pattern: list, where: list, value: list | None) -> Group:
        """A new column: the list of value (or the count, if None) over a pattern's matches, for each row."""
        names = [v for v in self.bound if v in _mentioned(pattern)]
        sub = Query(self.graph)
        sub.df = self.df.select(*(F.col(f"`{v}`") for v in names)).distinct() if names else None
        sub.bound = {v: self.bound[v] for v in names}
        sub.match(pattern)
        if where:
            sub.where(where)
        col = next(self.fresh).replace("__v", "__sub")
        agg = F.count(F.lit(1)) if value is None else F.collect_list(F.expr(expr(value, sub.bound)))
        keys = [F.col(f"`{v}`.__id").alias(f"__k{n}") for n, v in enumerate(names)] + [F.col(f"`{v}`.__label").alias(f"__l{n}") for n, v in enumerate(names) if self.bound[v] == "node"]
        got = sub.df.groupBy(*keys).agg(agg.alias(col))
        on = F.lit(True)
        for n, v in enumerate(names):
            on = on & (F.col(f"`{v}`.__id") == F.col(f"__k{n}"))
            if self.bound[v] == "node":
                on = on & (F.col(f"`{v}`.__label") == F.col(f"__l{n}"))
        none = F.lit(0) if value is None else F.array().cast(got.schema[col].dataType)
        self.df = self.df.join(got, on, "left").withColumn(col, F.coalesce(F.col(col), none)).drop(*(f"__k{n}" for n in range(len(names))), *(f"__l{n}" for n in range(len(names))))
        return _raw(col)

    def semi(self, pattern: list, negated: bool) -> None:
        w = find(pattern, "WHERE")
        sub = Query(self.graph)
        names = [v for v in self.bound if v in _mentioned(pattern)]
        keyed = self.df.select(*(F.col(f"`{v}`") for v in names)).distinct() if names else None
        sub.df, sub.bound = keyed, {v: self.bound[v] for v in names}
        sub.match(pattern[:w] if w >= 0 else pattern)
        if w >= 0:
            sub.where(pattern[w + 1 :])
        hit = sub.df.select(*(F.col(f"`{v}`.__id").alias(f"__k{n}") for n, v in enumerate(names)), *(F.col(f"`{v}`.__label").alias(f"__l{n}") for n, v in enumerate(names) if self.bound[v] == "node")).distinct()
        on = None
        for n, v in enumerate(names):
            one = F.col(f"`{v}`.__id") == F.col(f"__k{n}")
            if self.bound[v] == "node":
                one &= F.col(f"`{v}`.__label") == F.col(f"__l{n}")
            on = one if on is None else on & one
        self.df = self.df.join(hit, on if on is not None else F.lit(True), "left_anti" if negated else "left_semi")

    def optional(self, items: list, where: list) -> None:
        before, bound = self.df, dict(self.bound)
        if before is None:
            before = self.graph.engine.spark.range(1).select(F.lit(1).alias("__one"))
            bound = {}
        keys = list(bound)
        inner = Query(self.graph)
        inner.fresh = self.fresh
        inner.df = before.select(*(F.col(f"`{k}`") for k in keys)).distinct() if keys else None
        inner.bound = dict(bound)
        inner.match(items)
        if where:
            inner.where(where)
        new = [v for v in inner.bound if v not in bound]
        right = inner.df.select(*(F.col(f"`{k}`").alias(f"__o{n}") for n, k in enumerate(keys)), *(F.col(f"`{v}`") for v in new))
        on = F.lit(True)
        for n, k in enumerate(keys):
            on = on & F.col(f"`{k}`").eqNullSafe(F.col(f"__o{n}"))
        self.df = before.join(right, on, "left").drop(*(f"__o{n}" for n in range(len(keys))))
        self.bound = inner.bound

    def project(self, items: list, tail: dict[str, list], where: list) -> None:
        distinct = bool(items) and dialect._is(items[0], "DISTINCT")
        items = self.nested(items[distinct:]) if self.df is not None else items[distinct:]
        cols: list[tuple[str, str, bool, str]] = []
        for part in split(items):
            if len(part) == 1 and isinstance(part[0], Tok) and part[0].text == "*":
                cols += [(f"`{v}`", v, False, k) for v, k in self.bound.items() if not v.startswith("__v")]
                continue
            k = find(part, "AS")
            name = part[k + 1].text.strip("`") if k >= 0 else _name(part)
            body = part[:k] if k >= 0 else part
            kind = self.bound.get(body[0].text, "value") if len(body) == 1 and isinstance(body[0], Tok) else "value"
            cols.append((expr(body, self.bound), name, aggregated(body), kind))
        df = self.df if self.df is not None else self.graph.engine.spark.range(1)
        keys = [F.expr(e).alias(n) for e, n, agg, _ in cols if not agg]
        order = [(o, _order(o, self.bound, cols)) for o in split(tail.get("ORDER", []))]
        if any(agg for _, _, agg, _ in cols):
            names = [n for _, n, agg, _ in cols if not agg]
            aggs = [F.expr(e).alias(n) for e, n, agg, _ in cols if agg]
            df = df.groupBy(*keys).agg(*aggs).select(*(F.col(f"`{n}`") for _, n, _, _ in cols)) if names else df.agg(*aggs)
        else:
            hidden = [] if distinct else [F.expr(e).alias(f"__h{n}") for n, (_, (e, _, out)) in enumerate(order) if not out]
            df = df.select(*keys, *hidden)
        if distinct:
            df = df.distinct()
        if order:
            keys = []
            for n, (_, (e, desc, out)) in enumerate(order):
                c = F.expr(e) if out or f"__h{n}" not in df.columns else F.col(f"__h{n}")
                keys.append(c.desc_nulls_first() if desc else c.asc_nulls_last())
            df = df.orderBy(*keys)
        if "SKIP" in tail:
            df = df.offset(int(expr(tail["SKIP"])))
        if "LIMIT" in tail:
            df = df.limit(int(expr(tail["LIMIT"])))
        self.df = df.drop(*(c for c in df.columns if c.startswith("__h")))
        self.bound = {n: k for _, n, _, k in cols}
        if where:
            self.where(where)

    def unwind(self, items: list) -> None:
        k = find(items, "AS")
        df = self.df if self.df is not None else self.graph.engine.spark.range(1).select()
        self.df = df.select("*", F.explode(F.expr(expr(items[:k], self.bound))).alias(items[k + 1].text))
        self.bound[items[k + 1].text] = "value"

    def call(self, items: list, yields: list) -> None:
        if isinstance(items[0], Group) and items[0].open == "{":
            sub_items = items[0].items
            if sub_items and dialect._is(sub_items[0], "WITH"):  # correlated: named variables come along
                names = [p[0].text for p in split(sub_items[1 : _next_clause(sub_items, 1)])]
                sub = Query(self.graph)
                sub.df = self.df.select(*(F.col(f"`{v}`") for v in names)).distinct()
                sub.bound = {v: self.bound[v] for v in names}
                body = sub_items[_next_clause(sub_items, 1) :]
                ret = find(body, "RETURN")
                keep = [Tok("op", ",")] + [t for n, v in enumerate(names) for t in ([Tok("op", ",")] if n else []) + [Tok("id", v), Tok("id", "AS"), Tok("id", f"__c_{v}")]]
                end = next((j for j in range(ret + 1, len(body)) if dialect._is(body[j], "ORDER", "SKIP", "LIMIT")), len(body))
                sub.run(body[:end] + keep + body[end:])
                on = F.lit(True)
                for v in names:
                    on = on & F.col(f"`{v}`").eqNullSafe(F.col(f"`__c_{v}`"))
                self.df = self.df.join(sub.df, on).drop(*(f"__c_{v}" for v in names))
                self.bound |= {k: v for k, v in sub.bound.items() if not k.startswith("__c_")}
            else:
                sub = run(self.graph, sub_items)
                self.df = sub if self.df is None else self.df.crossJoin(sub)
                self.bound |= dict.fromkeys(sub.columns, "value")
            return
        from .procedures import call

        name = "".join(x.text for x in items if isinstance(x, Tok))
        args = [eval(_literal(a), {"__builtins__": {}}) for a in split(items[-1].items)] if isinstance(items[-1], Group) else []  # noqa: S307  literals only, see _literal
        out = call(self.graph, name, *args)
        cols = {}
        for y in split(yields):
            cols[y[0].text] = y[-1].text
        if cols:
            out = out.select(*(F.col(a).alias(b) for a, b in cols.items()))
        self.df = out if self.df is None else self.df.crossJoin(out)
        self.bound |= dict.fromkeys(out.columns, "value")

    def run(self, items: list) -> Query:
        parts = _clauses(items)
        i = 0
        while i < len(parts):
            word, body = parts[i]
            follow: dict[str, list] = {}
            where: list = []
            yields: list = []
            while i + 1 < len(parts) and parts[i + 1][0] in ("WHERE", "ORDER", "SKIP", "LIMIT", "YIELD"):
                i += 1
                if parts[i][0] == "WHERE":
                    where = parts[i][1]
                elif parts[i][0] == "YIELD":
                    yields = parts[i][1]
                else:
                    follow[parts[i][0]] = parts[i][1]
            if word == "MATCH":
                self.match(body)
                if where:
                    self.where(where)
            elif word == "OPTIONAL":
                self.optional(body, where)
            elif word in ("WITH", "RETURN"):
                self.project(body, follow, where)
            elif word == "UNWIND":
                self.unwind(body)
            elif word == "CALL":
                self.call(body, yields)
                if where:
                    self.where(where)
            else:
                from .mutate import apply

                apply(self, word, body)
            i += 1
        return self


def _literal(items: list) -> str:
    text = "".join(f"[{_literal(x.items)}]" if isinstance(x, Group) and x.open == "[" else x.text if isinstance(x, Tok) else "!" for x in items)
    if not re.fullmatch(r"(?:[\d.,\[\]+-]|[eE](?=[\d+-])|'[^']*'|true|false|null)*", text):
        raise ValueError("procedure arguments must be literals")
    return {"true": "True", "false": "False", "null": "None"}.get(text, text)


def _order(items: list, bound: dict, cols: list) -> tuple[str, bool, bool]:
    """(expression, descending, whether it reads the projected columns)."""
    desc = bool(items) and dialect._is(items[-1], "DESC", "DESCENDING")
    body = items[:-1] if items and dialect._is(items[-1], "DESC", "DESCENDING", "ASC", "ASCENDING") else items
    text = expr(body, bound)
    for e, n, agg, _ in cols:
        if e == text or n == _name(body):
            return f"`{n}`", desc, True
    names = {n for _, n, _, _ in cols}
    first = body[0].text if isinstance(body[0], Tok) else ""
    return text, desc, first in names


def _conjuncts(items: list) -> list[list]:
    return split(items, "AND") if find(items, "OR") < 0 and find(items, "XOR") < 0 else [items]


def _is_pattern(items: list) -> bool:
    return len(items) >= 3 and isinstance(items[0], Group) and items[0].open == "(" and any(isinstance(x, Group) and x.open == "[" for x in items[1:4]) and isinstance(items[-1], Group) and isinstance(items[1], Tok) and items[1].text in ("-", "<")


def _mentioned(items: list) -> set[str]:
    return {x.text for x in items if isinstance(x, Tok)} | {v for x in items if isinstance(x, Group) for v in _mentioned(x.items)}


def _next_clause(items: list, start: int) -> int:
    return next((i for i in range(start, len(items)) if any(find(items[i : i + len(w)], *w) == 0 for w in _CLAUSES)), len(items))


def _clauses(items: list) -> list[tuple[str, list]]:
    out, i = [], 0
    while i < len(items):
        words = next((w for w in _CLAUSES if find(items[i : i + len(w)], *w) == 0), None)
        if words is None:
            raise ValueError(f"a clause was expected at {_name(items[i : i + 3])}")
        j = i + len(words)
        while j < len(items):
            w = next((w for w in _CLAUSES if find(items[j : j + len(w)], *w) == 0), None)
            if w and not (w == ("WITH",) and dialect._is(items[j - 1], "STARTS", "ENDS")):
                break
            j += 1
        out.append((words[0], items[i + len(words) : j]))
        i = j
    return out


def run(graph, text) -> DataFrame:
    """A whole query: parts joined by UNION [ALL]."""
    items = parse(text) if isinstance(text, str) else text
    while items and dialect._is(items[-1], ";"):
        items.pop()
    out, last, every = None, 0, False
    cuts = [i for i, x in enumerate(items) if dialect._is(x, "UNION")] + [len(items)]
    for c in cuts:
        part = Query(graph).run(items[last:c]).df
        if part is None:
            part = graph.engine.spark.range(0).select()
        part = part.select(*(F.col(f"`{x}`") for x in part.columns if not x.startswith("__v")))
        out = part if out is None else out.unionByName(part) if every else out.unionByName(part).distinct()
        last = c + 1
        every = last < len(items) and dialect._is(items[last], "ALL")
        last += every
    return out
