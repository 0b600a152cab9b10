"""Best-first search over sparse tables against SQL, brute force and awkward rows."""

import random

import duckdb
import numpy as np
import pytest

from seekwell.llm import ranked_search as R

from .fixtures import ITEMS, ROWS, benchmark, documents, rows_of

NAMES = ["item_id", "rank", "doc_id", "score"]


def from_sql(rows, items, k):
    db = duckdb.connect()
    db.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    db.execute("CREATE TABLE benchmark (item_id BIGINT, text VARCHAR)")
    if rows:
        db.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    db.executemany("INSERT INTO benchmark VALUES (?, ?)", items)
    cur = db.execute(R.sql(k))
    names = [d[0] for d in cur.description]
    return sorted((tuple(r[names.index(n)] for n in NAMES) for r in cur.fetchall()), key=repr)


@pytest.mark.parametrize("options", [{}, {"k": 3}, {"k": 2, "block_postings": 50, "item_bytes": 300}])
def test_awkward_rows(spark, options):
    out = R.ranked(documents(spark), benchmark(spark), **options)
    assert out.columns == NAMES
    assert rows_of(out) == from_sql(ROWS, ITEMS, options.get("k", R.K))


def test_empty_tables(spark):
    assert R.ranked(documents(spark).limit(0), benchmark(spark)).count() == 0
    assert R.ranked(documents(spark), benchmark(spark).limit(0)).count() == 0


def test_many_equal_scores(spark):
    rows = [(i, "alpha beta gamma" if i % 3 else "alpha delta") for i in range(400)]
    items = [(1, "Alpha BETA"), (2, "delta"), (3, "nothing here")]
    assert rows_of(R.ranked(documents(spark, rows), benchmark(spark, items), k=7, block_postings=90)) == from_sql(rows, items, 7)


def test_block_prunes_and_stays_exact():
    rnd = random.Random(3)
    n_terms, docs = 40, 3000
    ids = [np.array(sorted(rnd.sample(range(n_terms), rnd.randint(1, 12))), np.int32) for _ in range(docs)]
    tfs = [np.array([min(9, int(rnd.paretovariate(1.2))) for _ in x], np.int32) for x in ids]
    norms = np.array([rnd.randint(55, 400) for _ in range(docs)])
    block = R.Block(ids, tfs, norms, n_terms)
    for trial in range(20):
        asked = np.array(sorted(rnd.sample(range(n_terms), rnd.randint(1, 10))))
        w = np.array([rnd.randint(0, 6000) for _ in asked])
        brute = np.zeros(docs, np.int64)
        for d, (i, t) in enumerate(zip(ids, tfs)):
            for a, b in zip(i, t):
                if a in asked:
                    brute[d] += w[list(asked).index(a)] * ((1_000_000_000 * int(b)) // (1000 * int(b) + 20 * int(norms[d])))
        found, scores = block.search(asked, w, 10, 0)
        assert (brute[found] == scores).all() and len(set(found.tolist())) == len(found)
        want = sorted((-s, d) for d, s in enumerate(brute.tolist()) if s > 0)[:10]
        assert sorted((-s, d) for d, s in zip(found.tolist(), scores.tolist()))[:10] == want
        if want:  # with a bound from elsewhere nothing below it comes back, and nothing at it is lost
            least = -want[-1][0]
            again, more = block.search(asked, w, 10, least)
            assert set(zip(again.tolist(), more.tolist())) == {(d, s) for d, s in enumerate(brute.tolist()) if s >= max(least, 1)} or len(want) < 10
