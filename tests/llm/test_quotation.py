"""Quotation linking on messages with nested quotes, against its SQL and by hand."""

import duckdb

from seekwell.llm import quotation

ROWS = [
    (1, 0, "user", "Hello there\nhow are you\n\nSecond  Paragraph here"),
    (1, 1, "assistant", "> hello there\n> How are   you\n\nFine thanks"),
    (1, 2, "user", ">> Hello there\n>> how are you\n> fine THANKS\n\nGood to hear"),
    (1, 3, "user", "> Second paragraph here\n\nAbout that"),
    (1, 4, "user", "Hello there\nhow are you"),
    (1, 5, "user", "> never written\nanother start"),
    (1, 6, "user", "> Good to hear\n>> Fine thanks\nok"),
    (1, 6, "user", "> Good to hear\n>> Fine thanks\nok"),
    (2, 0, "user", "> Good to hear\nother conversation"),
    (2, 1, "user", None), (2, 2, "user", ""), (None, 3, "user", "> other conversation"), (2, None, "user", "> other conversation\nx"),
    (3, 0, "user", "> later"), (3, 1, "user", "later"),
]
SCHEMA = "conv_id long, turn long, role string, text string"


def result(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).withColumnsRenamed({})
    return sorted((tuple(r) for r in quotation.threads(df).collect()), key=str), quotation.threads(df).columns


def test_links_by_hand_and_sql(spark):
    got, columns = result(spark, ROWS)
    by = {(r[0], r[1]): dict(zip(columns, r)) for r in got}
    assert [by[1, t]["parent_turn"] for t in range(7)] == [None, 0, 1, 0, None, None, 2]
    assert [by[1, t]["depth"] for t in range(7)] == [0, 1, 2, 1, 0, 0, 3]
    assert by[1, 1]["own_text"] == "Fine thanks" and by[1, 2]["max_level"] == 2 and by[1, 2]["n_linked"] == 2
    assert by[1, 6]["thread_turn"] == 0 and by[2, 0]["parent_turn"] is None and by[3, 0]["parent_turn"] is None
    con = duckdb.connect()
    con.execute("CREATE TABLE t (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO t VALUES (?, ?, ?, ?)", ROWS)
    cur = con.execute(quotation.sql("t"))
    names = [d[0] for d in cur.description]
    want = sorted((tuple(r[names.index(c)] for c in columns) for r in cur.fetchall()), key=str)
    assert got == want


def test_long_chain_and_empty(spark):
    chain = [(1, 0, "user", "line 0")] + [(1, t, "user", f"> line {t - 1}\nline {t}") for t in range(1, 40)]
    got, columns = result(spark, chain)
    at = {c: columns.index(c) for c in columns}
    assert {r[at["depth"]] for r in got} == set(range(40)) and {r[at["position"]] for r in got} == set(range(1, 41)) and {r[at["thread_turn"]] for r in got} == {0}
    assert result(spark, [])[0] == []
