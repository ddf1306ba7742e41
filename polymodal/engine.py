"""The engine: a catalog of DataFrames that answers SQL of the PostgreSQL dialect, graph queries and searches."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from . import calls, sources, statements
from .functions import register
from .operators import constraints, dml, recursive, sequences
from .plans import dialect, typed


class Engine:
    """Tables are DataFrames under names; statements that change a table put a new DataFrame under its name."""

    def __init__(self, spark: SparkSession):
        self.spark, self.tables = spark, {}
        self.sequences: dict[str, sequences.Sequence] = {}
        self.enums: dict[str, list[str]] = {}
        self.constraints: dict[str, list[constraints.Constraint]] = {}
        self.defaults: dict[str, dict[str, list]] = {}
        self._saved: list[tuple[str, dict]] = []
        self._last: sequences.Sequence | None = None
        register(spark)
        # generated code of a full outer join keeps all matches of a key in memory before it hands out the first; the iterator hands out each
        spark.conf.set("spark.sql.codegen.join.fullOuterSortMergeJoin.enabled", False)
        from .graph import Graph

        self.graph = Graph(self)

    # ------------------------------------------------------------ catalog

    def register(self, name: str, df: DataFrame) -> DataFrame:
        old = self.tables.get(name)
        self.tables[name] = df
        if old is not None:  # labels over the table see what it has become
            for label, (table, key) in self.graph.nodes.items():
                if table is old:
                    self.graph.nodes[label] = (df, key)
            for e in self.graph.edges.values():
                if e.table is old:
                    e.table = df
        df.createOrReplaceTempView(name)
        return df

    def change(self, name: str, df: DataFrame) -> DataFrame:
        """register() for a statement that changes rows: the table's constraints, and foreign keys that point at it, must hold."""
        constraints.enforce(name, df, self.constraints.get(name, []), lambda t: df if t == name else self.table(t))
        for other, own in self.constraints.items():
            pointing = [c for c in own if c.parent and c.parent[0] == name] if other != name and other in self.tables else []
            constraints.enforce(other, self.table(other), pointing, lambda t: df if t == name else self.table(t)) if pointing else None
        return self.register(name, df)

    # --------------------------------------------------------- transactions

    def begin(self, name: str = "") -> None:
        """Keeps what every name stands for. DataFrames don't change, so this costs nothing."""
        self._saved.append((name, dict(tables=dict(self.tables), constraints=dict(self.constraints), defaults=dict(self.defaults), enums=dict(self.enums))))

    def commit(self) -> None:
        self._saved.clear()

    def rollback(self, name: str | None = None) -> None:
        """To the beginning, or to a savepoint, which stays. Sequences go on, as numbers once handed out are not handed out again."""
        at = 0 if name is None else max((k for k, (n, _) in enumerate(self._saved) if n == name), default=-1)
        if not self._saved:
            return
        if at < 0:
            raise ValueError(f"no savepoint {name}")
        state = self._saved[at][1]
        for gone in self.tables.keys() - state["tables"].keys():
            self.tables.pop(gone)
            self.spark.catalog.dropTempView(gone)
        for k, df in state["tables"].items():
            if self.tables.get(k) is not df:
                self.register(k, df)
        self.constraints, self.defaults, self.enums = dict(state["constraints"]), dict(state["defaults"]), dict(state["enums"])
        del self._saved[at if name is None else at + 1 :]

    def release(self, name: str) -> None:
        at = max((k for k, (n, _) in enumerate(self._saved) if n == name), default=-1)
        if at < 0:
            raise ValueError(f"no savepoint {name}")
        del self._saved[at:]

    def load(self, folder: str, *names: str) -> Engine:
        for n in names:
            self.register(n, self.spark.read.parquet(f"{folder}/{n}.parquet"))
        return self

    def table(self, name: str) -> DataFrame:
        return self.tables[name] if name in self.tables else self.spark.table(name)

    def function(self, name: str, args: str, returns: str, body: str) -> None:
        """CREATE FUNCTION ... LANGUAGE sql: a SQL function that Catalyst inlines."""
        self.spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {returns} RETURN {dialect.rewrite_expression(body)}")

    # ---------------------------------------------------------------- SQL

    def sql(self, text: str) -> DataFrame:
        """A statement of the dialect; graph queries are told by their first words."""
        if re.match(r"(?is)\s*(?:(?:OPTIONAL\s+)?MATCH\b|UNWIND\b|CALL\b|(?:CREATE|MERGE)\s*\()", text):
            return self.graph.query(text)
        items = dialect.tree(dialect.tokenize(text))
        while items and dialect._is(items[-1], ";"):
            items.pop()
        first = items[0].up() if items else ""
        for word, run in (("EXPLAIN", self._explain), ("CREATE", self._create), ("INSERT", self._insert), ("UPDATE", self._update), ("DELETE", self._delete), ("MERGE", self._merge), ("TRUNCATE", self._truncate), ("DROP", self._drop), ("TABLE", lambda i: self.table(i[1].text))):
            if first == word:
                return run(items)
        if first in statements.TRANSACTION:
            return statements.transaction(self, items)
        if first in statements.IGNORED:
            return statements.done(self, first)
        for word, run in (("ALTER", statements.alter), ("COPY", statements.copy), ("SET", statements.setting), ("SHOW", statements.setting), ("RESET", statements.setting)):
            if first == word:
                return run(self, items)
        if first == "SELECT" and (k := dialect.find(items, "INTO")) > 0:
            return self.register(items[k + 1].text, self._query(items[:k] + items[k + 2 :]))
        return self._query(items)

    def _query(self, items: list) -> DataFrame:
        items, numbered = self._row_numbers(items)
        items = self._session_calls(items)
        if numbered:
            return self._numbered(self._query(items), numbered)
        if len(items) > 1 and dialect._is(items[0], "WITH") and dialect._is(items[1], "RECURSIVE"):
            items = self._distinct_recursion(items)
        if any(dialect._is(x, "information_schema".upper()) for x in items):
            sources.information_schema_tables(self.spark, self.tables).createOrReplaceTempView("__is_tables")
            sources.information_schema_columns(self.spark, self.tables).createOrReplaceTempView("__is_columns")
            text = re.sub(r"(?i)\binformation_schema\s*\.\s*(tables|columns)", r"__is_\1", dialect.statement(items))
            return typed.sql(self.spark, text)
        return typed.sql(self.spark, dialect.statement(items))

    def _row_numbers(self, items: list) -> tuple[list, dict[str, sequences.Sequence]]:
        """nextval in the select list of a query over tables takes a number a row: its place is held by a column, which is numbered afterwards."""
        f = dialect.find(items, "FROM")
        if not items or not dialect._is(items[0], "SELECT") or f < 0:
            return items, {}
        out, numbered = [items[0]], {}
        for k, part in enumerate(dialect.split(items[1:f])):
            out += [dialect.Tok("op", ",")] if k else []
            if len(part) > 1 and isinstance(part[0], dialect.Tok) and part[0].text.lower() == "nextval" and isinstance(part[1], dialect.Group):
                name = part[-1].text if len(part) > 2 else "nextval"
                numbered[name] = self.sequences[calls.value(part[1].items)]
                out += [dialect.Tok("id", "NULL"), dialect.Tok("op", "::"), dialect.Tok("id", "bigint"), dialect.Tok("id", "AS"), dialect.Tok("id", name)]
            else:
                out += part
        return (out + items[f:], numbered) if numbered else (items, {})

    def _numbered(self, df: DataFrame, numbered: dict[str, sequences.Sequence]) -> DataFrame:
        from pyspark.sql import functions as F

        cols, df = df.columns, recursive.cut(df.withColumn("__at", F.monotonically_increasing_id()))
        for name, s in numbered.items():
            df = s.number(df.drop(name), name, "__at")
            self._last = s
        return df.orderBy("__at").select(*cols)

    def _session_calls(self, items: list) -> list:
        """Calls that the session answers while the statement is planned: searches after FROM, sequences, settings, enumerations."""
        out: list = []
        i = 0
        while i < len(items):
            x, nxt = items[i], items[i + 1] if i + 1 < len(items) else None
            call = isinstance(x, dialect.Tok) and x.kind == "id" and isinstance(nxt, dialect.Group) and nxt.open == "("
            name = x.text.lower() if call else ""
            if name in calls.HITS and out and dialect._is(out[-1], "FROM", "JOIN", ","):
                view = f"__hits_{len(self.tables)}_{id(nxt)}"
                calls.hits(self, name, nxt.items).createOrReplaceTempView(view)
                out.append(dialect.Tok("id", view))
                i += 2
                if not (i < len(items) and (dialect._is(items[i], "AS") or isinstance(items[i], dialect.Tok) and items[i].kind == "id" and items[i].up() not in dialect._STOP)):
                    out += [dialect.Tok("id", "AS"), dialect.Tok("id", name)]
                continue
            if name in calls.SESSION:
                out.append(dialect.Group("(", calls.session(self, name, nxt.items)))
                i += 2
                continue
            out.append(dialect.Group(x.open, self._session_calls(x.items)) if isinstance(x, dialect.Group) else x)
            i += 1
        return out

    def _distinct_recursion(self, items: list) -> list:
        """Recursive members under UNION (not ALL) run as fixpoints and become views."""
        out, i = items[:1], 2
        plain = []
        while True:
            name, i = items[i], i + 1
            cols = None
            if isinstance(items[i], dialect.Group):
                cols, i = [c[0].text for c in dialect.split(items[i].items)], i + 1
            body = items[i + 1]
            u = dialect.find(body.items, "UNION")
            if u >= 0 and not dialect._is(body.items[u + 1], "ALL"):
                base = self.spark.sql(dialect.statement(body.items[:u]))
                base = base.toDF(*cols) if cols else base
                step_sql = dialect.statement(body.items[u + 1 :])

                def step(new: DataFrame, name=name.text, sql=step_sql) -> DataFrame:
                    new.createOrReplaceTempView(name)
                    return self.spark.sql(sql)

                recursive.fixpoint(base, step).createOrReplaceTempView(name.text)
            else:
                plain += ([dialect.Tok("op", ",")] if plain else []) + items[i - 1 - (cols is not None) : i + 2]
            i += 2
            if i < len(items) and dialect._is(items[i], ","):
                i += 1
                continue
            break
        return (out + items[1:2] + plain if plain else []) + items[i:]

    def _explain(self, items: list) -> DataFrame:
        k = next(i for i, x in enumerate(items) if dialect._is(x, "SELECT", "WITH", "VALUES"))
        return self.spark.sql("EXPLAIN FORMATTED " + dialect.statement(items[k:]))

    def _create(self, items: list) -> DataFrame:
        words = [x.up() for x in items if isinstance(x, dialect.Tok)]
        if "LABEL" in words[:3]:
            return statements.label(self, items)
        if "FUNCTION" in words[:4]:
            return statements.function(self, items)
        if words[1] in ("INDEX", "UNIQUE", "EXTENSION", "SCHEMA", "ROLE", "COLLATION"):
            return statements.done(self, f"CREATE {words[1]}")
        as_ = dialect.find(items, "AS")
        if ("TABLE" in words or "VIEW" in words) and as_ > 0:
            name = next(x for x in reversed(items[:as_]) if isinstance(x, dialect.Tok))
            return self.register(name.text, self._query(items[as_ + 1 :]))
        if "TABLE" in words:
            return statements.create_table(self, items)
        if "SEQUENCE" in words:
            n = lambda word, default: int(items[dialect.find(items, word) + 1 + (dialect._is(items[dialect.find(items, word) + 1], "WITH", "BY"))].text) if dialect.find(items, word) > 0 else default
            self.sequences[items[2].text] = sequences.Sequence(n("START", 1), n("INCREMENT", 1))
            return self.spark.createDataFrame([(items[2].text,)], "sequence string")
        if "ENUM" in words:
            self.enums[items[2].text.lower()] = [dialect._unquote(v[0].text) for v in dialect.split(items[-1].items)]
            return self.spark.createDataFrame([(v,) for v in self.enums[items[2].text.lower()]], "label string")
        raise ValueError("tables, views, sequences and enumerations are created here")

    def _drop(self, items: list) -> DataFrame:
        if dialect._is(items[1], "NODE", "EDGE"):
            return statements.label(self, items)
        if not dialect._is(items[1], "TABLE", "VIEW", "SEQUENCE"):
            return statements.done(self, f"DROP {items[1].up()}")
        name = next(x.text for x in reversed(items) if not dialect._is(x, "CASCADE", "RESTRICT"))
        if self.sequences.pop(name, None):
            return statements.done(self, "DROP SEQUENCE")
        self.tables.pop(name, None)
        self.constraints.pop(name, None)
        self.defaults.pop(name, None)
        self.spark.catalog.dropTempView(name)
        return self.spark.createDataFrame([], "dropped string")

    def _truncate(self, items: list) -> DataFrame:
        return self.change(items[-1].text, self.table(items[-1].text).limit(0))

    def _insert(self, items: list) -> DataFrame:
        name, i = items[2].text, 3
        cols = None
        if isinstance(items[i], dialect.Group):
            cols, i = [c[0].text for c in dialect.split(items[i].items)], i + 1
        table = self.table(name)
        conflict, ret = dialect.find(items, "ON", "CONFLICT"), dialect.find(items, "RETURNING")
        end = min(k for k in (conflict, ret, len(items)) if k >= 0)
        from pyspark.sql import functions as F

        given = cols or table.columns
        if dialect._is(items[i], "DEFAULT"):  # DEFAULT VALUES
            rows, given = self.spark.range(1).select(), []
        else:
            rows = self._query(items[i:end])
            given = given[: len(rows.columns)]
            rows = rows.toDF(*given)
        rows, absent = self._defaults(name, rows, [c for c in table.columns if c not in given])
        rows = rows.select(*((F.col(c) if c in absent or c in given else F.lit(None)).cast(table.schema[c].dataType).alias(c) for c in table.columns))
        if conflict >= 0:
            keys = [c[0].text for c in dialect.split(items[conflict + 2].items)] if isinstance(items[conflict + 2], dialect.Group) else table.columns
            s = dialect.find(items, "SET", start=conflict)
            stop = ret if ret >= 0 else len(items)
            w = dialect.find(items, "WHERE", start=conflict)
            sets = self._sets(items[s + 1 : w if w >= 0 else stop], name) if s >= 0 else None
            after = dml.upsert(table, rows, keys, sets, self._named(items[w + 1 : stop], name) if w >= 0 else None)
        else:
            after = dml.insert(table, rows)
        self.change(name, after)
        return rows if ret < 0 else self._returning(rows, items[ret + 1 :])

    def _defaults(self, name: str, rows: DataFrame, absent: list[str]) -> tuple[DataFrame, set[str]]:
        """rows with the defaults of columns that they lack; a sequence's numbers go row by row."""
        from pyspark.sql import functions as F

        filled = set()
        for c, items in self.defaults.get(name, {}).items():
            if c in absent:
                call = len(items) == 2 and isinstance(items[0], dialect.Tok) and items[0].text.lower() == "nextval"
                rows = self._numbered(rows.withColumn(c, F.lit(None).cast("long")), {c: self.sequences[calls.value(items[1].items)]}) if call else rows.withColumn(c, F.expr(dialect.expression(self._session_calls(items))))
                filled.add(c)
        return rows, filled

    def _returning(self, rows: DataFrame, items: list) -> DataFrame:
        return rows.selectExpr(*(dialect.expression(x) for x in dialect.split(items)))

    def _named(self, items: list, table: str) -> str:
        return re.sub(rf"\b{re.escape(table)}\.", "t.", dialect.expression(items))

    def _sets(self, items: list, table: str) -> dict[str, str]:
        return {p[0].text: self._named(p[2:], table) for p in dialect.split(items)}

    def _update(self, items: list) -> DataFrame:
        name, s = items[1].text, dialect.find(items, "SET")
        alias = items[s - 1].text if s > 2 else name
        f, w, ret = (dialect.find(items, k) for k in ("FROM", "WHERE", "RETURNING"))
        stop = min(k for k in (f, w, ret, len(items)) if k >= 0)
        end = ret if ret >= 0 else len(items)
        cond, sets = items[w + 1 : end] if w >= 0 else [], self._sets(items[s + 1 : stop], alias)
        table = self.table(name)
        if f >= 0:
            other, short = items[f + 1].text, items[f + 2].text if f + 2 < w and isinstance(items[f + 2], dialect.Tok) else items[f + 1].text
            sub = lambda t: re.sub(rf"\b{re.escape(short)}\.", "s.", t)
            after = dml.update_from(table, self.table(other), sub(self._named(cond, alias)), {k: sub(v) for k, v in sets.items()}, table.columns)
        else:
            after = dml.update(table.alias("t"), sets, self._named(cond, alias) if cond else "true")
        self.change(name, after)
        changed = dml.returning(table, after)
        return changed if ret < 0 else self._returning(changed, items[ret + 1 :])

    def _delete(self, items: list) -> DataFrame:
        name, u, w, ret = items[2].text, *(dialect.find(items, k) for k in ("USING", "WHERE", "RETURNING"))
        table = self.table(name)
        cond = items[w + 1 : ret if ret >= 0 else len(items)] if w >= 0 else []
        if u >= 0:
            other, short = items[u + 1].text, items[w - 1].text
            after = dml.delete_using(table, self.table(other), re.sub(rf"\b{re.escape(short)}\.", "s.", self._named(cond, name)))
        else:
            after = dml.delete(table.alias("t"), self._named(cond, name) if cond else "true")
        self.change(name, after)
        gone = table.exceptAll(after)
        return gone if ret < 0 else self._returning(gone, items[ret + 1 :])

    def _merge(self, items: list) -> DataFrame:
        u, on = dialect.find(items, "USING"), dialect.find(items, "ON")
        name, short = items[2].text, items[u - 1].text
        source = items[u + 1]
        src = self.spark.sql(dialect.statement(source.items)) if isinstance(source, dialect.Group) else self.table(source.text)
        other = items[on - 1].text
        starts = [i for i in range(on, len(items)) if dialect._is(items[i], "WHEN")]

        def text(part: list) -> str:
            t = re.sub(rf"\b{re.escape(short)}\.", "t.", dialect.expression(part))
            return re.sub(rf"\b{re.escape(other)}\.", "s.", t)

        clauses: dict[str, list] = {"m": [], "n": [], "s": []}
        for a, b in zip(starts, [*starts[1:], len(items)]):
            part = items[a:b]
            th = dialect.find(part, "THEN")
            kind = "m" if dialect._is(part[1], "MATCHED") else "s" if dialect.find(part, "BY", "SOURCE") > 0 else "n"
            k = dialect.find(part, "AND")
            cond = text(part[k + 1 : th]) if 0 <= k < th else "true"
            act = part[th + 1 :]
            if dialect._is(act[0], "UPDATE"):
                what = {p[0].text: text(p[2:]) for p in dialect.split(act[2:])}
            elif dialect._is(act[0], "DELETE"):
                what = "delete"
            elif dialect._is(act[0], "INSERT"):
                v = dialect.find(act, "VALUES")
                cols = [c[0].text for c in dialect.split(act[1].items)] if isinstance(act[1], dialect.Group) else self.table(name).columns
                what = dict(zip(cols, (text(x) for x in dialect.split(act[v + 1].items)))) if v >= 0 else {c: "NULL" for c in cols}
            else:
                what = "nothing" if kind != "n" else None
            clauses[kind].append((cond, what))
        after = dml.merge(self.table(name), src, text(items[on + 1 : starts[0]]), clauses["m"], clauses["n"], clauses["s"])
        return self.change(name, after)

    def query_to_xml(self, text: str, row: str = "row", top: str = "table") -> DataFrame:
        """One row: the query's rows as elements of one XML document."""
        from pyspark.sql import functions as F

        rows = self.sql(text)
        one = rows.select(F.to_xml(F.struct("*"), {"rowTag": row}).alias("x"))
        return one.agg(F.concat(F.lit(f"<{top}>"), F.listagg("x", F.lit("")), F.lit(f"</{top}>")).alias("xml"))

    def table_to_xml(self, name: str) -> DataFrame:
        return self.query_to_xml(f"SELECT * FROM {name}", top=name)

    def expr(self, text: str):
        """A Column of a dialect expression."""
        from pyspark.sql import functions as F

        return F.expr(dialect.rewrite_expression(text))
