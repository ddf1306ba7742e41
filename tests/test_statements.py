"""What statements mean by the types of their operands, transactions, constraints and sequences."""

import pytest

from polymodal import Engine


@pytest.fixture()
def e(spark):
    engine = Engine(spark)
    engine.register("t", spark.createDataFrame([(1, 7, 2.5, [1, 2]), (2, -7, 3.5, [])], "id int, v int, x double, a array<int>"))
    return engine


def rows(e, text):
    return [tuple(r) for r in e.sql(text).collect()]


def test_integers_divide_to_integers(e):
    assert rows(e, "SELECT v / 2, (v / 2) / 2, v / 2.0, x / 2, 10 / 4 * 2 FROM t WHERE v / 3 = 2 OR v / 3 = -2 ORDER BY id") == [(3, 1, pytest.approx(3.5), 1.25, 4), (-3, -1, pytest.approx(-3.5), 1.75, 4)]
    assert rows(e, "SELECT id FROM t WHERE id = (SELECT max(v) / 4 FROM t) + 0") == [(1,)]
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO"):
        rows(e, "SELECT 1 / (id - id) FROM t")


def test_fractions_round_to_integers(e):
    assert rows(e, "SELECT x::int, x::numeric(10, 1)::int, CAST(-x AS bigint), '2.7'::numeric::bigint, '7'::int FROM t ORDER BY id") == [(2, 3, -2, 3, 7), (4, 4, -4, 3, 7)]


def test_dates_and_arrays(e):
    assert rows(e, "SELECT DATE '2020-03-01' - DATE '2020-02-01', (DATE '2020-03-01' - DATE '2020-02-01') / 2, DATE '2020-03-01' - 1") == [(29, 14, __import__("datetime").date(2020, 2, 29))]
    assert rows(e, "SELECT a || v, v || a, a || a, a || 1 || 2, 'x' || v FROM t WHERE id = 1") == [([1, 2, 7], [7, 1, 2], [1, 2, 1, 2], [1, 2, 1, 2], "x7")]


def test_sequences_number_rows(e):
    e.sql("CREATE SEQUENCE s START 10 INCREMENT 5")
    assert sorted(n for _, n in rows(e, "SELECT id, nextval('s') AS n FROM t")) == [10, 15]
    assert rows(e, "SELECT nextval('s'), currval('s')") == [(20, 20)]
    e.sql("CREATE TABLE u (id serial PRIMARY KEY, v int)")
    e.sql("INSERT INTO u (v) SELECT v FROM t")
    e.sql("INSERT INTO u (v) VALUES (5)")
    assert sorted(i for i, _ in rows(e, "SELECT * FROM u")) == [1, 2, 3]


def test_transactions_put_back_what_was(e):
    for text in ("BEGIN", "DELETE FROM t WHERE id = 1", "CREATE TABLE made (a int)", "SAVEPOINT one", "DELETE FROM t", "ROLLBACK TO SAVEPOINT one"):
        e.sql(text)
    assert rows(e, "SELECT id FROM t") == [(2,)] and "made" in e.tables
    e.sql("ROLLBACK")
    assert len(rows(e, "SELECT id FROM t")) == 2 and "made" not in e.tables
    for text in ("BEGIN", "DELETE FROM t", "COMMIT", "ROLLBACK"):
        e.sql(text)
    assert rows(e, "SELECT id FROM t") == []
    with pytest.raises(ValueError):
        e.sql("BEGIN") and e.sql("ROLLBACK TO nowhere")


def test_constraints_are_kept(e):
    e.sql("CREATE TABLE p (id int PRIMARY KEY, v int CHECK (v > 0), s text NOT NULL DEFAULT 'none', UNIQUE (v, s))")
    e.sql("INSERT INTO p (id, v) VALUES (1, 1), (2, 2)")
    e.sql("CREATE TABLE c (pid int REFERENCES p (id))")
    e.sql("INSERT INTO c VALUES (1), (NULL)")
    for text in ("INSERT INTO p VALUES (1, 9, 'x')", "INSERT INTO p VALUES (NULL, 9, 'x')", "INSERT INTO p VALUES (3, -1, 'x')", "INSERT INTO p VALUES (3, 1, 'none')", "INSERT INTO p VALUES (3, 3, NULL)", "UPDATE p SET v = 0", "INSERT INTO c VALUES (7)", "DELETE FROM p WHERE id = 1", "ALTER TABLE p ADD CONSTRAINT two CHECK (v < 2)"):
        with pytest.raises(ValueError, match="constraint"):
            e.sql(text)
    assert sorted(rows(e, "SELECT * FROM p")) == [(1, 1, "none"), (2, 2, "none")]
    e.sql("INSERT INTO p VALUES (3, NULL, 'x')")  # unknown passes a check
    e.sql("ALTER TABLE p ADD CONSTRAINT most CHECK (v < 3)")
    with pytest.raises(ValueError, match="most"):
        e.sql("INSERT INTO p VALUES (4, 5, 'y')")
    e.sql("ALTER TABLE p DROP CONSTRAINT most")
    e.sql("INSERT INTO p VALUES (4, 5, 'y')")
    e.sql("DELETE FROM p WHERE id = 2")
