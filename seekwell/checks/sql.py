"""SQL fragments shared by the expected results."""

from __future__ import annotations


def num(x) -> str:
    """A literal that DuckDB reads as DOUBLE, never DECIMAL."""
    return f"{float(x)!r}e0" if "e" not in repr(float(x)) else repr(float(x))


WS = "string_split({c}, ' ')"


def bm25(name="run", k=10, k1=0.9, b=0.4, length_norm=False, tok="string_split({c}, ' ')", queries="benchmark") -> str:
    """CTEs ending in ``name(qid, docid, score, rank)`` for benchmark (or a like table) against documents."""
    norm = "dl.dl / n.avgdl" if length_norm else "dl.dl"
    doc_tok, q_tok = tok.format(c="text"), tok.format(c="text")
    return f"""
{name}_d AS (SELECT doc_id, unnest({doc_tok}) AS token FROM documents),
{name}_p AS (SELECT doc_id, token, count(*) AS tf FROM {name}_d GROUP BY doc_id, token),
{name}_l AS (SELECT doc_id, len({doc_tok}) AS dl FROM documents),
{name}_n AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM {name}_l),
{name}_t AS (SELECT token, count(*) AS df FROM {name}_p GROUP BY token),
{name}_q AS (SELECT item_id AS qid, unnest({q_tok}) AS token FROM {queries}),
{name}_s AS (SELECT q.qid, p.doc_id AS docid,
   round(sum(ln((n.n - t.df + 0.5e0) / (t.df + 0.5e0) + 1) * {num(k1 + 1)} * p.tf
       / (p.tf + {num(k1)} * ({num(1 - b)} + {num(b)} * {norm}))), 6) AS score
   FROM {name}_q q JOIN {name}_p p USING (token) JOIN {name}_t t USING (token)
   JOIN {name}_l dl ON dl.doc_id = p.doc_id CROSS JOIN {name}_n n GROUP BY q.qid, p.doc_id),
{name} AS (SELECT qid, docid, score, rank FROM (
   SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, docid) AS rank FROM {name}_s WHERE score <> 0) WHERE rank <= {k})"""


def dense(name="dense", k=10, skip_self=True, digits=6) -> str:
    """CTEs ending in ``name(qid, docid, score, rank)`` for embeddings against themselves."""
    where = "WHERE a.vec_id <> b.vec_id" if skip_self else ""
    return f"""
{name}_v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
{name}_s AS (SELECT a.vec_id AS qid, b.vec_id AS docid, round(list_dot_product(a.e, b.e), {digits}) AS score
   FROM {name}_v a CROSS JOIN {name}_v b {where}),
{name} AS (SELECT qid, docid, score, rank FROM (
   SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, docid) AS rank FROM {name}_s) WHERE rank <= {k})"""


def ranked(source: str, k: int | None = None, by="qid", score="score", tie="docid", cols="*") -> str:
    cut = f"WHERE rank <= {k}" if k else ""
    return (f"SELECT {cols} FROM (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY {score} DESC, {tie}) AS rank "
            f"FROM {source}) {cut}")


def lcs(name: str, source: str) -> str:
    """CTE ``name(id, lcs)``: longest common subsequence of the token lists ``a`` and ``b`` of ``source(id, a, b)``, row by row."""
    return f"""{name}_b AS (SELECT id, unnest(range(1, len(b) + 1)) AS i, unnest(b) AS u FROM {source}),
{name} AS (WITH RECURSIVE r AS (
   SELECT id, 0::BIGINT AS i, unnest(range(1, len(a) + 1)) AS j, unnest(a) AS t, 0 AS v FROM {source}
   UNION ALL SELECT id, i, j, t, max(c) OVER (PARTITION BY id ORDER BY j) AS v FROM (
     SELECT r.id, x.i, r.j, r.t, CASE WHEN r.t = x.u THEN coalesce(lag(r.v) OVER (PARTITION BY r.id ORDER BY r.j), 0) + 1 ELSE r.v END AS c FROM r JOIN {name}_b x ON x.id = r.id AND x.i = r.i + 1))
 SELECT s.id, coalesce(max(r.v), 0) AS lcs FROM {source} s LEFT JOIN r ON r.id = s.id GROUP BY s.id)"""


SIMPLE = r"regexp_extract_all({c}, '[\p{{L}}\p{{N}}\p{{M}}]+|[^\p{{Z}}\p{{C}}]')"


def simple(c: str) -> str:
    return SIMPLE.format(c=c)


def padded(c: str) -> str:
    """Lower-case simple tokens joined by spaces with a space at both ends."""
    return f"(' ' || array_to_string({simple(f'lower({c})')}, ' ') || ' ')"


# Documents that contain a benchmark text as a run of tokens.
QRELS = f"""
qrels_d AS (SELECT doc_id AS docid, {padded('text')} AS t FROM documents),
qrels_q AS (SELECT item_id AS qid, {padded('text')} AS t FROM benchmark),
qrels AS (SELECT qid, docid FROM qrels_q q JOIN qrels_d d ON contains(d.t, q.t))"""

# Vectors with the same label are relevant to each other.
VEC_QRELS = """
vec_qrels AS (SELECT a.vec_id AS qid, b.vec_id AS docid FROM embeddings a JOIN embeddings b
   ON a.label = b.label AND a.vec_id <> b.vec_id)"""
