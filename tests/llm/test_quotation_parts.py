"""Trimmed and re-wrapped quotes, by hand."""

from seekwell.llm import quotation

ROWS = [
    (1, 0, "user", "First line here\nsecond line here\nthird line here\n\nAnother passage"),
    (1, 1, "assistant", "> second   LINE here\nreply to one line"),
    (1, 2, "user", "> first line here\n> third line here\nreply to two lines"),
    (1, 3, "user", "> First line\n> here second line here third\n> line here\nreply to all, wrapped anew"),
    (1, 4, "user", "> first line here\n> not a line of anybody\nreply to nothing"),
    (1, 5, "user", "> second line here\n> reply to one line\nlatest of both"),
    (1, 6, "user", "> second line here\n\n> another passage\n>> third line here\ntwo quotes"),
    (1, 6, "user", "> second line here\n\n> another passage\n>> third line here\ntwo quotes"),
    (1, 7, "user", "> line here\nonly part of a line"),
    (1, 8, "user", "> written\nx"), (1, 9, "user", "other\nwritten"),
    (2, 0, "user", "> second line here\nother conversation"),
    (3, 0, "user", "common\nrare one\nend"), (3, 1, "user", "common\nrare two"), (3, 2, "user", "> common\n> rare two\n> common\nx"),
]


def test_trimmed_and_wrapped_quotes(spark):
    df = spark.createDataFrame(ROWS, "conv_id long, turn long, role string, text string")
    got = quotation.threads(df).collect()
    assert len(got) == len(ROWS)
    by = {(r.conv_id, r.turn): r for r in got}
    assert [by[1, t].parent_turn for t in range(10)] == [None, 0, 0, 0, None, 1, 0, None, None, None]
    assert [by[1, t].n_linked for t in range(10)] == [0, 1, 1, 1, 0, 1, 3, 0, 0, 0]
    assert by[1, 5].depth == 2 and by[1, 5].thread_turn == 0
    assert by[2, 0].parent_turn is None and by[3, 2].parent_turn == 1
