"""Statements besides queries and row changes: columns and names of tables, graph labels, COPY, functions, settings; maintenance is accepted and does nothing."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import sources
from .operators.constraints import Constraint, enforce
from .operators.sequences import Sequence
from .plans import dialect
from .plans.dialect import Group, find, split

#: Statements of transactions: a session's own names and what they stand for are kept and put back.
TRANSACTION = frozenset("BEGIN START COMMIT END ROLLBACK ABORT SAVEPOINT RELEASE".split())
#: Statements without effect on DataFrames.
IGNORED = frozenset("ANALYZE VACUUM CHECKPOINT LOCK DISCARD LISTEN UNLISTEN NOTIFY REINDEX CLUSTER COMMENT DEALLOCATE".split())


def done(engine, what: str) -> DataFrame:
    return engine.spark.createDataFrame([(what,)], "statement string")


def transaction(engine, items: list) -> DataFrame:
    """BEGIN, COMMIT, ROLLBACK [TO [SAVEPOINT] name], SAVEPOINT name, RELEASE [SAVEPOINT] name."""
    verb, words = items[0].up(), [x for x in items[1:] if not dialect._is(x, "SAVEPOINT", "TRANSACTION", "WORK")]
    if verb in ("BEGIN", "START"):
        engine.begin()
    elif verb in ("COMMIT", "END"):
        engine.commit()
    elif verb == "SAVEPOINT":
        engine.begin(words[0].text)
    elif verb == "RELEASE":
        engine.release(words[0].text)
    elif words and dialect._is(words[0], "TO"):
        engine.rollback(words[1].text)
    else:
        engine.rollback()
    return done(engine, verb)


_CONSTRAINT = ("PRIMARY", "FOREIGN", "CHECK", "UNIQUE", "CONSTRAINT")


def _names(g) -> list[str]:
    return [c[0].text for c in split(g.items)]


def _constraints(items: list, table: str, column: str | None) -> list[Constraint]:
    """Those that a column's definition, or a table's constraint (column None), spells out."""
    out, i, name = [], 0, ""
    own = [column] if column else []
    while i < len(items):
        x, nxt = items[i], items[i + 1] if i + 1 < len(items) else None
        group = lambda k: items[k] if k < len(items) and isinstance(items[k], Group) else None
        if dialect._is(x, "CONSTRAINT"):
            name, i = nxt.text, i + 1
        elif dialect._is(x, "NOT") and nxt is not None and dialect._is(nxt, "NULL"):
            out.append(Constraint("not null", own, name or f"{table}_{column}_not_null"))
        elif dialect._is(x, "PRIMARY"):
            cols = own or _names(group(i + 2))
            out.append(Constraint("primary", cols, name or f"{table}_pkey"))
        elif dialect._is(x, "UNIQUE"):
            cols = own or _names(group(i + 1))
            out.append(Constraint("unique", cols, name or f"{table}_{'_'.join(cols)}_key"))
        elif dialect._is(x, "CHECK"):
            out.append(Constraint("check", dialect.expression(nxt.items), name or f"{table}_check"))
        elif dialect._is(x, "FOREIGN"):
            own = _names(group(i + 2))
        elif dialect._is(x, "REFERENCES"):
            keys = _names(group(i + 2)) if group(i + 2) else own
            out.append(Constraint("foreign", own, name or f"{table}_{'_'.join(own)}_fkey", (nxt.text, keys)))
        i += 1
    return out


def create_table(engine, items: list) -> DataFrame:
    """CREATE [TEMP] TABLE [IF NOT EXISTS] t (column type [DEFAULT value] [constraint ...], ..., table constraint, ...) ..."""
    at = next(i for i, x in enumerate(items) if isinstance(x, Group))
    name, parts = items[at - 1].text, split(items[at].items)
    if dialect.find(items, "IF", "NOT", "EXISTS") >= 0 and name in engine.tables:
        return engine.table(name)
    columns, rules, defaults = [], [], {}
    for p in parts:
        if dialect._is(p[0], *_CONSTRAINT):
            rules += _constraints(p, name, None)
            continue
        column = p[0].text
        kind, used = dialect._type(p[1:])
        rest = p[1 + used :]
        columns.append(f"{column} {kind}")
        if p[1].text.lower() in ("serial", "bigserial", "smallserial") or dialect.find(rest, "AS", "IDENTITY") >= 0:
            engine.sequences[f"{name}_{column}_seq"] = Sequence()
            defaults[column] = [dialect.Tok("id", "nextval"), Group("(", [dialect.Tok("str", dialect._quote(f"{name}_{column}_seq"))])]
        k = find(rest, "DEFAULT")
        if k >= 0:
            end = next((j for j in range(k + 1, len(rest)) if dialect._is(rest[j], "NOT", "REFERENCES", *_CONSTRAINT)), len(rest))
            defaults[column] = rest[k + 1 : end]
            rest = rest[:k] + rest[end:]
        rules += _constraints(rest, name, column)
    engine.constraints[name], engine.defaults[name] = rules, defaults
    return engine.register(name, engine.spark.createDataFrame([], ", ".join(columns)))


def alter(engine, items: list) -> DataFrame:
    """ALTER TABLE t: ADD / DROP / RENAME COLUMN, RENAME TO, ALTER COLUMN TYPE, SET / DROP DEFAULT and NOT NULL, ADD / DROP CONSTRAINT; a constraint that the rows break is not added."""
    whole = items
    items = [x for x in items if not dialect._is(x, "IF", "EXISTS", "NOT", "ONLY")]
    name, rest = items[2].text, [x for x in items[3:] if not dialect._is(x, "COLUMN")]
    df = engine.table(name)
    verb = rest[0].up()
    if verb == "RENAME" and dialect._is(rest[1], "TO"):
        for kept in (engine.constraints, engine.defaults):
            kept[rest[2].text] = kept.pop(name, kept.get(rest[2].text, type(kept.get(name, []))()))
        engine.tables.pop(name, None)
        engine.spark.catalog.dropTempView(name)
        return engine.register(rest[2].text, df)
    if verb == "RENAME":
        return engine.register(name, df.withColumnRenamed(rest[1].text, rest[3].text))
    if verb == "DROP" and not dialect._is(rest[1], "CONSTRAINT"):
        return engine.register(name, df.drop(rest[1].text))
    if verb == "ADD" and not dialect._is(rest[1], "CONSTRAINT", "PRIMARY", "FOREIGN", "UNIQUE", "CHECK"):
        kind, used = dialect._type(rest[2:])
        k = find(rest, "DEFAULT")
        value = F.expr(dialect.expression(rest[k + 1 :])) if k >= 0 else F.lit(None)
        return engine.register(name, df.withColumn(rest[1].text, value.cast(kind)))
    rules = engine.constraints.setdefault(name, [])
    if verb == "ADD":
        new = _constraints(whole[find(whole, "ADD") + 1 :], name, None)
        enforce(name, df, new, lambda t: df if t == name else engine.table(t))
        rules += new
        return df
    if verb == "DROP":
        engine.constraints[name] = [c for c in rules if c.name != rest[-1].text and c.name != rest[2].text]
        return df
    if verb == "ALTER" and find(rest, "DEFAULT") >= 0:
        k = find(rest, "DEFAULT")
        own = engine.defaults.setdefault(name, {})
        own.pop(rest[1].text, None)
        if dialect._is(rest[k - 1], "SET"):
            own[rest[1].text] = rest[k + 1 :]
        return df
    if verb == "ALTER" and find(whole, "NOT", "NULL") >= 0:
        new = Constraint("not null", [rest[1].text], f"{name}_{rest[1].text}_not_null")
        engine.constraints[name] = [c for c in rules if c.name != new.name]
        if dialect._is(rest[2], "SET"):
            enforce(name, df, [new], engine.table)
            engine.constraints[name].append(new)
        return df
    if verb == "ALTER" and (k := find(rest, "TYPE")) >= 0:
        return engine.register(name, df.withColumn(rest[1].text, F.col(rest[1].text).cast(dialect._type(rest[k + 1 :])[0])))
    return df


def label(engine, items: list) -> DataFrame:
    """CREATE NODE LABEL l ON t [KEY (id)]; CREATE EDGE LABEL l ON t SOURCE a TARGET b [(source column, target column)]; DROP of both."""
    kind, name = items[1].up(), items[3].text
    if dialect._is(items[0], "DROP"):
        (engine.graph.drop_node_label if kind == "NODE" else engine.graph.drop_edge_label)(items[-1].text)
        return done(engine, f"DROP {kind} LABEL")
    table = items[find(items, "ON") + 1].text
    cols = [c[0].text for x in items if isinstance(x, Group) for c in split(x.items)]
    if kind == "NODE":
        engine.graph.node_label(name, table, cols[0] if cols else "id")
    else:
        s, t = items[find(items, "SOURCE") + 1].text, items[find(items, "TARGET") + 1].text
        engine.graph.edge_label(name, table, s, t, *(cols or ["source_id", "target_id"]))
    return done(engine, f"CREATE {kind} LABEL")


def copy(engine, items: list) -> DataFrame:
    """COPY t FROM 'path' and COPY t | (query) TO 'path', [WITH] (FORMAT csv, HEADER, DELIMITER ';', NULL '')."""
    f, t = find(items, "FROM"), find(items, "TO")
    k = f if f > 0 else t
    path, options = dialect._unquote(items[k + 1].text), {}
    for part in (split(items[-1].items) if isinstance(items[-1], Group) and len(items) > k + 2 else [[x] for x in items[k + 2 :] if not dialect._is(x, "WITH")]):
        options[part[0].up()] = part[1].text if len(part) > 1 else "true"
    clean = lambda v: dialect._unquote(v) if v and v.startswith("'") else v
    fmt = "csv" if "CSV" in options or clean(options.get("FORMAT", "")).lower() == "csv" else "text"
    args = {"fmt": fmt, "header": clean(options.get("HEADER", "false")).lower() in ("true", "on"), "delimiter": clean(options.get("DELIMITER")), "null": clean(options.get("NULL"))}
    if f > 0:
        name = items[1].text
        table = engine.table(name)
        schema = ", ".join(f"`{c.name}` {c.dataType.simpleString()}" for c in table.schema.fields)
        return engine.change(name, table.unionByName(sources.copy_from(engine.spark, path, schema, **args)))
    df = engine.spark.sql(dialect.statement(items[1].items)) if isinstance(items[1], Group) else engine.table(items[1].text)
    sources.copy_to(df, path, mode="overwrite", **args)
    return done(engine, "COPY")


def function(engine, items: list) -> DataFrame:
    """CREATE [OR REPLACE] FUNCTION f(a type, ...) RETURNS type ... {AS 'SELECT expression' | RETURN expression}: inlined by Catalyst."""
    k = find(items, "FUNCTION")
    name, args = items[k + 1].text, split(items[k + 2].items)
    names = [a[0].text for a in args]
    params = ", ".join(f"{a[0].text} {dialect._type(a[1:])[0]}" for a in args)
    returns, _ = dialect._type(items[find(items, "RETURNS") + 1 :])
    r = find(items, "RETURN")
    if r >= 0:
        body = dialect.expression(items[r + 1 :])
    else:
        text = next(dialect._unquote(x.text) for x in reversed(items) if isinstance(x, dialect.Tok) and x.kind == "str" and " " in x.text)
        text = re.sub(r"\$(\d+)", lambda m: names[int(m[1]) - 1], text.strip().rstrip(";"))
        inner = dialect.tree(dialect.tokenize(text))
        body = dialect.expression(inner[1:]) if dialect._is(inner[0], "SELECT") and find(inner, "FROM") < 0 else f"({dialect.statement(inner)})"
    engine.spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({params}) RETURNS {returns} RETURN {body}")
    return done(engine, "CREATE FUNCTION")


def setting(engine, items: list) -> DataFrame:
    """SET name {TO | =} value, SHOW name, RESET name: of the Spark session."""
    verb = items[0].up()
    words = items[1:][dialect._is(items[1], "SESSION", "LOCAL") :]
    at = next((k for k, x in enumerate(words) if dialect._is(x, "TO", "=")), len(words))
    name = "".join(x.text for x in words[:at])
    if verb == "SET":
        engine.spark.conf.set(name, "".join(dialect._unquote(x.text) if x.kind == "str" else x.text for x in words[at + 1 :]))
    elif verb == "RESET":
        engine.spark.conf.unset(name)
    return engine.spark.createDataFrame([(engine.spark.conf.get(name, None),)], "setting string")
