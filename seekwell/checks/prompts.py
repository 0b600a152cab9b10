"""Prompts, hooks, end-to-end jobs and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from seekwell.checks import sql as S
from seekwell.checks.evaluation import items
from seekwell.checks.registry import register
from seekwell.checks.retrieval import APP_BM25, WORDS, bm25_run, dense_run
from seekwell.checks.text import PAIRS_SQL, turn_pairs
from seekwell.operators import dense as D, evaluation as E, fusion as X, hooks as K, lexical as L, prompts as P
from seekwell.plans import jobs as J
from seekwell.plans.turns import Service, question_turn
from seekwell.scale import scratch_path
from seekwell.sources.files import split_by_ratio
from seekwell.streaming import service as St

TASK_OF = {"user": "qa", "assistant": "chat", "system": "icl"}
TASK_SQL = "CASE role WHEN 'user' THEN 'qa' WHEN 'assistant' THEN 'chat' ELSE 'icl' END"


def with_task(t):
    return t.conversations.withColumn("task", F.element_at(E.literal_map(TASK_OF), F.col("role")))


def _prefix(family: str, side: int) -> str:
    table = P.INSTRUCTIONS[family]
    pick = lambda task: table.get(task, table.get("*"))[side]
    return f"CASE role WHEN 'user' THEN '{pick('qa')}' WHEN 'assistant' THEN '{pick('chat')}' ELSE '{pick('icl')}' END"


@register("instruction_prefixes", "WITH " + "c AS (SELECT * FROM conversations) " + " UNION ALL ".join(
    f"SELECT conv_id, turn, '{f}' AS family, {_prefix(f, 0)} || text AS query, {_prefix(f, 1)} || text AS key FROM c" for f in P.INSTRUCTIONS))
def _(t):
    from seekwell.scale import stack

    rows = with_task(t).select("conv_id", "turn", "task", F.col("text").alias("query"), F.col("text").alias("key"))
    return stack(*[P.with_instructions(rows, f).select("conv_id", "turn", F.lit(f).alias("family"), "query", "key") for f in P.INSTRUCTIONS])


@register("score_prompts", f"""WITH p AS (SELECT a.conv_id * 1000 + a.turn AS qid, {TASK_SQL.replace('role', 'a.role')} AS task, a.text AS query, [b.text, a.text] AS keys, [b.text, a.text, 'none'] AS answers FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1),
 e AS (SELECT qid, task, query, answers[('0x' || substr(md5('42|' || qid), 1, 8))::BIGINT % 3 + 1] AS answer, unnest(keys) AS k, unnest([0, 1]) AS key_index FROM p), c AS (SELECT *, array_to_string(string_split(k, ' ')[1:40], ' ') AS key FROM e)
 SELECT qid, task, key_index, CASE task WHEN 'qa' THEN 'Knowledge: ' || trim(key) || chr(10) || chr(10) || 'Question: ' || trim(query) || chr(10) || chr(10) || 'Answer: ' || trim(answer)
  WHEN 'icl' THEN key || chr(10) || query || chr(10) || answer ELSE key || chr(10) || 'Speaker 1: ' || query || chr(10) || 'Speaker 2: ' || answer END AS prompt FROM c""")
def _(t):
    rows = turn_pairs(t).join(with_task(t).select("conv_id", "turn", "task"), ["conv_id", "turn"]).select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("qid"), "task", F.col("pred").alias("query"), F.array("gold", "pred").alias("keys"), F.array("gold", "pred", F.lit("none")).alias("answers"))
    return P.score_prompts(rows, 40)


CHAT = """f AS (SELECT conv_id, arg_min(role, turn) AS r, min(turn) AS t FROM conversations GROUP BY conv_id),
 k AS (SELECT c.conv_id, c.turn, c.role, c.text, role || ': ' || text AS line, c.turn - f.t - (f.r <> 'user')::INT AS pos FROM conversations c JOIN f ON f.conv_id = c.conv_id WHERE NOT (c.turn = f.t AND f.r <> 'user'))"""


@register("chat_rows", f"""WITH {CHAT}, s AS (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) = role AS same, len(string_split(line, ' ')) AS n FROM k)
 SELECT conv_id, sum(n)::BIGINT AS length, string_agg(line, chr(10) ORDER BY turn) AS prompt, NOT bool_or(coalesce(same, false)) AS alternates FROM s GROUP BY conv_id HAVING sum(n) BETWEEN 20 AND 400""")
def _(t):
    return P.chat_rows(t.conversations, 20, 400)


@register("chat_rows_with_answer", f"""WITH {CHAT} SELECT conv_id, len(string_split(max(CASE WHEN pos = 0 THEN line END), ' ')) AS length, max(CASE WHEN pos = 0 THEN line END) AS prompt, max(CASE WHEN pos = 1 THEN text END) AS answer
 FROM k WHERE pos <= 1 GROUP BY conv_id HAVING len(string_split(max(CASE WHEN pos = 0 THEN line END), ' ')) BETWEEN 10 AND 400""")
def _(t):
    return P.chat_rows(t.conversations, 10, 400, expect_answer=True)


@register("few_shot_same_task_first", f"""WITH {S.dense('run', 20)}, r AS (SELECT r.qid, r.docid, row_number() OVER (PARTITION BY r.qid ORDER BY (a.label <> b.label)::INT, r.rank) AS rank FROM run r JOIN embeddings a ON a.vec_id = r.qid JOIN embeddings b ON b.vec_id = r.docid) SELECT * FROM r WHERE rank <= 8""")
def _(t):
    tasks = items(t)
    return P.same_task_first(dense_run(t, 20), tasks.select(F.col("id").alias("qid"), F.col("label").alias("task")), tasks.select(F.col("id").alias("docid"), F.col("label").alias("task")), 8)


@register("few_shot_same_task_random", """WITH o AS (SELECT vec_id AS docid, label, row_number() OVER (PARTITION BY label ORDER BY md5('42|' || vec_id), vec_id) AS pos, count(*) OVER (PARTITION BY label) AS n FROM embeddings),
 q AS (SELECT e.vec_id AS qid, label, ('0x' || substr(md5('42|' || e.vec_id), 1, 15))::BIGINT AS start, unnest(range(1, least(8, (SELECT count(*) FROM embeddings x WHERE x.label = e.label)) + 1)) AS rank FROM embeddings e)
 SELECT qid, docid, rank FROM q JOIN o ON o.label = q.label AND o.pos = (q.start + q.rank) % o.n + 1""")
def _(t):
    tasks = items(t)
    return P.same_task_random(tasks.select(F.col("id").alias("qid"), F.col("label").alias("task")), tasks.select(F.col("id").alias("docid"), F.col("label").alias("task")), 8)


@register("few_shot_other_properties", """WITH p AS (SELECT * FROM (SELECT lang AS prop, doc_id, row_number() OVER (PARTITION BY lang ORDER BY md5('42|' || doc_id), doc_id) AS rank FROM documents) WHERE rank <= 2)
 SELECT d.doc_id AS qid, p.prop, p.rank, p.doc_id AS docid FROM documents d JOIN p ON p.prop <> d.lang""")
def _(t):
    return P.other_property_examples(t.documents.select(F.col("doc_id").alias("qid"), F.col("lang").alias("prop")), t.documents.select(F.col("lang").alias("prop"), F.col("doc_id").alias("id")), 2)


def shots(t):
    """Three worked examples per turn: the turn itself, the next one, and both."""
    return turn_pairs(t).withColumn("shots", F.array("pred", "gold", F.concat("pred", F.lit(" "), "gold"))).withColumn("keys", F.array("gold", "pred"))


SHOTS = f"""{PAIRS_SQL}, s AS (SELECT *, [pred, gold, pred || ' ' || gold] AS shots, [gold, pred] AS keys, 'Question: ' || trim(pred) || chr(10) || 'Answer:' AS question FROM p)"""
FIT = "list_filter({x}, lambda y, i: list_sum(list_transform({x}[1:i], lambda z: len(string_split(z, ' ')))) <= {room})"


@register("question_prompts", f"""WITH {SHOTS}, w AS (SELECT *, {FIT.format(x='shots', room="150 - len(string_split(question, ' '))")} AS fit FROM s),
 r AS (SELECT *, chr(10) || chr(10) || array_to_string(list_transform(fit, lambda x: x || chr(10) || chr(10)), '') || question AS rgt, 'Knowledge: ' || gold || chr(10) || pred AS lft FROM w)
 SELECT conv_id, turn, regexp_replace(array_to_string(string_split(lft, ' ')[1:greatest(150 - len(string_split(rgt, ' ')), 0)], ' ') || rgt, '^\\s+|\\s+$', '', 'g') AS prompt FROM r""")
def _(t):
    return shots(t).select("conv_id", "turn", P.qa_prompt(F.col("pred"), F.col("keys"), F.col("shots"), 150).alias("prompt"))


@register("few_shot_prompts", f"""WITH {SHOTS}, w AS (SELECT *, {FIT.format(x='list_reverse(shots)', room="200 - len(string_split(pred, ' '))")}[1:2] AS fit FROM s)
 SELECT conv_id, turn, array_to_string(fit || [pred], chr(10)) || chr(10) AS prompt FROM w""")
def _(t):
    return shots(t).select("conv_id", "turn", P.few_shot_prompt(F.col("pred"), F.col("shots"), 200, 2).alias("prompt"))


SAMPLE = "trim(text) || chr(10) || 'A. ' || lang || chr(10) || 'B. ' || source || chr(10) || 'C. yes' || chr(10) || 'D. no' || chr(10) || 'Answer: '"


@register("choice_prompts", f"""WITH d AS (SELECT doc_id AS qid, lang, source, text, 'The following are multiple choice questions (with answers) about ' || source || ' in ' || lang || '.' || chr(10) || chr(10) || 'Q' || chr(10) || chr(10) AS fixed, {SAMPLE} AS smp FROM documents),
 k AS (SELECT *, 2000 - len(string_split(fixed || smp || 'A', ' ')) AS room, 'Knowledge:' || chr(10) || source || ' ' || text AS kn, unnest(['A', 'B', 'C', 'D']) AS option FROM d),
 l AS (SELECT *, CASE WHEN room > 0 THEN array_to_string(string_split(kn, ' ')[1:room], ' ') || chr(10) || chr(10) ELSE '' END || fixed || smp || option AS full_text FROM k)
 SELECT qid, option, array_to_string(CASE WHEN len(string_split(full_text, ' ')) > 2000 THEN string_split(full_text, ' ')[-2000:] ELSE string_split(full_text, ' ') END, ' ') AS prompt FROM l""")
def _(t):
    rows = t.documents.select(F.col("doc_id").alias("qid"), F.concat("source", F.lit("_in_"), "lang").alias("subject"), F.col("text").alias("query"),
                              F.array("lang", "source", F.lit("yes"), F.lit("no")).alias("choices"), F.array(F.concat("source", F.lit(" "), "text")).alias("keys"), F.array(F.lit("Q")).alias("shots"))
    return P.choice_prompts(rows, 2000)


@register("passkey_probes", f"""WITH d AS (SELECT doc_id, string_split(text, ' ') AS t, string_split('{P.PASSKEY_FACT}'.replace('{{passkey}}', (('0x' || substr(md5('42|' || doc_id), 1, 12))::BIGINT % 90000 + 10000)::VARCHAR), ' ') AS f, string_split('{P.PROBE_HEAD}', ' ') AS h, string_split('{P.PASSKEY_ASK}', ' ') AS a FROM documents),
 l AS (SELECT *, unnest([200, 1000]) AS length FROM d), x AS (SELECT *, unnest([0, 25, 50, 75, 100]) AS depth FROM l),
 y AS (SELECT *, len(h) AS lo, length - len(a) - len(f) - 1 AS hi, flatten(list_transform(range(0, ceil(length / len(t))::INT), lambda i: t))[1:length - len(h) - len(f) - len(a)] AS c FROM x),
 z AS (SELECT *, (lo + round_even((hi - lo) * depth / 100, 0))::INT AS pos FROM y)
 SELECT doc_id, length, depth, array_to_string(h || c[1:pos] || f || c[pos + 1:] || a, ' ') AS prompt FROM z WHERE hi >= lo""")
def _(t):
    key = P.passkey(F.col("doc_id"), 5)
    fact = F.replace(F.lit(P.PASSKEY_FACT), F.lit("{passkey}"), key)
    return P.insert_probes(t.documents, [200, 1000], [0, 25, 50, 75, 100], fact, P.PASSKEY_ASK)


TEMPLATES = {"en": "Read this.\n\n{context}\n\nQuestion: {input}\nAnswer:", "fr": "Lis ceci : {context} {input}", "de": "Lies das: {context}\n{input}", "es": "Lee esto: {context}\n{input}"}


@register("rendered_templates", """WITH d AS (SELECT doc_id, CASE lang WHEN 'en' THEN 'Read this.' || chr(10) || chr(10) || text || chr(10) || chr(10) || 'Question: ' || source || chr(10) || 'Answer:' WHEN 'fr' THEN 'Lis ceci : ' || text || ' ' || source
  WHEN 'de' THEN 'Lies das: ' || text || chr(10) || source ELSE 'Lee esto: ' || text || chr(10) || source END AS p, lang, source FROM documents), w AS (SELECT *, string_split(p, ' ') AS t FROM d)
 SELECT doc_id, array_to_string(CASE WHEN len(t) > 300 THEN t[1:150] || t[-150:] ELSE t END, ' ') AS prompt, lang || ' ' || CASE lang WHEN 'en' THEN 'A' WHEN 'fr' THEN 'B' WHEN 'de' THEN 'C' ELSE 'D' END AS gold FROM w""")
def _(t):
    rows = t.documents.select("doc_id", F.col("lang").alias("dataset"), F.col("text").alias("context"), F.col("source").alias("input"))
    gold = P.choice_gold(F.col("dataset"), F.array(*[F.lit(x) for x in ("en", "fr", "de", "es")]))
    return P.render_templates(rows, TEMPLATES, 300).select("doc_id", "prompt", F.array_join(gold, " ").alias("gold"))


BENCH_TEMPLATES = {"code_run": "{context}\nReturn value of {func_call}? {func} is defined above.", "code_debug": "{context}\nA. {OPTION_A}\nB. {OPTION_B}\nC. {OPTION_C}\nD. {OPTION_D}",
                   "math_find": "{prefix}\n{context}\n{input}", "longbook_qa_eng": "{context}\nQ: {question}"}
LETTER = "['A', 'B', 'C', 'D']"


@register("benchmark_prompts", f"""WITH d AS (SELECT doc_id, text, lang, source, ['en', 'de', 'fr', 'es'] AS options, CASE doc_id % 4 WHEN 0 THEN 'code_run' WHEN 1 THEN 'code_debug' WHEN 2 THEN 'math_find' ELSE 'longbook_qa_eng' END AS task FROM documents)
 SELECT doc_id, CASE task WHEN 'code_run' THEN text || chr(10) || 'Return value of func_' || doc_id || '(-' || length(text) || ')? func_' || doc_id || ' is defined above.'
   WHEN 'code_debug' THEN text || chr(10) || 'A. en' || chr(10) || 'B. de' || chr(10) || 'C. fr' || chr(10) || 'D. es'
   WHEN 'math_find' THEN 'What is the ' || lower(source) || ' number in the following list?' || chr(10) || text || chr(10) || 'The ' || upper(source) || ' Number of all'
   ELSE text || chr(10) || 'Q: ' || source END AS prompt,
   CASE WHEN task = 'code_debug' THEN lang || ' ' || {LETTER}[list_position(options, lang)] ELSE lang END AS gold FROM d""")
def _(t):
    which = F.col("doc_id") % 4
    task = F.when(which == 0, "code_run").when(which == 1, "code_debug").when(which == 2, "math_find").otherwise("longbook_qa_eng")
    call = F.concat(F.lit("What is func_"), "doc_id", F.lit("(-"), F.length("text"), F.lit(") and func_1(2)?"))
    asked = F.when(which == 0, call).when(which == 2, F.concat(F.lit("The "), F.upper("source"), F.lit(" Number of all"))).otherwise(F.col("source"))
    rows = t.documents.select("doc_id", task.alias("dataset"), F.col("text").alias("content"), asked.alias("input"), F.array("lang").alias("answer"),
                              F.array(*[F.lit(x) for x in ("en", "de", "fr", "es")]).alias("options"))
    out = P.render_templates(P.derived_fields(rows), BENCH_TEMPLATES)
    gold = P.gold_answers(F.col("dataset"), F.col("answer"), F.col("options"))
    return out.select("doc_id", "prompt", F.array_join(gold, " ").alias("gold"))


@register("hook_embeddings", r"""WITH t AS (SELECT item_id AS qid, unnest(list_filter(string_split_regex('query: ' || array_to_string(string_split(text, ' ')[1:128], ' '), '\s+'), lambda x: x <> '')) AS w FROM benchmark),
 v AS (SELECT qid, ('0x' || substr(md5(w), 1, 8))::BIGINT % 64 AS pos, sum(CASE WHEN ('0x' || substr(md5(w), 9, 2))::BIGINT % 2 = 1 THEN 1 ELSE -1 END) AS s FROM t GROUP BY ALL),
 n AS (SELECT qid, sqrt(sum(s * s)) AS n FROM v GROUP BY qid), g AS (SELECT item_id AS qid, unnest(range(64)) AS pos FROM benchmark)
 SELECT qid, pos::INT AS pos, round((coalesce(s, 0) / CASE WHEN n = 0 THEN 1 ELSE n END)::FLOAT::DOUBLE, 5) AS x FROM g LEFT JOIN v USING (qid, pos) JOIN n USING (qid)""")
def _(t):
    rows = K.embed(t.topics, "query", K.hashing_encoder(64), "query: ", 128).select("qid", F.posexplode("embedding").alias("pos", "x"))
    return rows.withColumn("x", F.round(F.col("x").cast("double"), 5))


def overlap_model():
    """Share of the query's distinct words inside the passage, as a Python scorer."""
    def score(queries, passages):
        out = []
        for q, p in zip(queries, passages):
            a, b = set(q.lower().split()), set(p.lower().split())
            out.append(len(a & b) / max(len(a), 1))
        return out
    return score


@register("hook_pair_scores", f"""WITH {S.bm25('run', 5)} SELECT qid, docid, round(1 / (1 + exp(-(len(list_intersect({WORDS.format(c='b.text')}, {WORDS.format(c='d.text')})) / len({WORDS.format(c='b.text')})))), 6) AS score
 FROM run r JOIN benchmark b ON b.item_id = r.qid JOIN documents d ON d.doc_id = r.docid""")
def _(t):
    rows = bm25_run(t, 5).select("qid", "docid").join(t.topics, "qid").join(t.corpus, "docid")
    return K.score_pairs(rows, "query", "text", overlap_model, normalize=True).select("qid", "docid", F.round("score", 6).alias("score"))


def failing_model():
    def ask(prompt):
        if prompt.startswith("The "):
            raise RuntimeError("refused")
        return prompt.split(" ")[0]
    return ask


@register("hook_generation", "SELECT conv_id, turn, CASE WHEN starts_with(text, 'The ') THEN '' ELSE split_part(text, ' ', 1) END AS answer FROM conversations")
def _(t):
    return K.generate(t.conversations, "text", failing_model).select("conv_id", "turn", "answer")


@register("hook_flat_map", "SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS line FROM conversations")
def _(t):
    split = lambda row: [{"conv_id": row["conv_id"], "turn": row["turn"], "line": x} for x in row["text"].split("\n")]
    return K.flat_map_rows(t.conversations.select("conv_id", "turn", "text"), split, "conv_id long, turn long, line string")


@register("hook_map_rows", "SELECT conv_id, turn, length(text)::BIGINT AS n FROM conversations WHERE role <> 'system'")
def _(t):
    size = lambda row: None if row["role"] == "system" else {"conv_id": row["conv_id"], "turn": row["turn"], "n": len(row["text"])}
    return K.map_rows(t.conversations, size, "conv_id long, turn long, n long")


@register("mean_vectors", """WITH u AS (SELECT label, vec_id + 1 AS w, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings) SELECT label, i AS pos, round(sum(w * x) / sum(w), 6) AS x FROM u GROUP BY label, i""")
def _(t):
    means = K.mean_vectors(t.embeddings.withColumn("w", F.col("vec_id") + 1), "label", "embedding", "w")
    return means.select("label", F.posexplode("embedding").alias("pos", "x")).withColumn("x", F.round("x", 6))


TWO_RUNS = f"{S.bm25('a', 20, 0.9, 0.4)}, {S.bm25('b', 20, 0.82, 0.68, True)}"
HYBRID = TWO_RUNS + """, p AS (SELECT coalesce(a.qid, b.qid) AS qid, coalesce(a.docid, b.docid) AS docid, b.score AS d, a.score AS s FROM a FULL JOIN b ON a.qid = b.qid AND a.docid = b.docid),
 f AS (SELECT qid, docid, round(0.3e0 * coalesce(s, min(s) OVER (PARTITION BY qid), 0) + coalesce(d, min(d) OVER (PARTITION BY qid), 0), 8) AS score FROM p), hy AS (""" + S.ranked("f", 5) + ")"


def faq(t):
    return t.documents.select(F.col("doc_id").alias("docid"), F.col("text").alias("question"), F.col("source").alias("answer"))


def containment_judge():
    """A stand-in judge: answered when the reference contains the question, irrelevant when
    its answer is one of the first ten sources, otherwise a reply of its own."""
    def ask(prompt):
        question, rest = prompt.split("\n参考问题：\n", 1)
        matched, answer = rest.rsplit("\n参考答案：\n", 1)
        if question.removeprefix("问题：\n") in matched:
            return "已解答"
        return "不相关" if len(answer) == 4 else "也许"
    return ask


def service_runs(t):
    return bm25_run(t, 20, k1=0.82, b=0.68, length_norm=True), bm25_run(t, 20)


@register("faq_match", f"""WITH {HYBRID} SELECT q.item_id AS qid, h.docid, d.text AS question, d.source AS answer, CASE WHEN h.docid IS NULL THEN 'clauses' WHEN contains(d.text, q.text) THEN 'answered' WHEN length(d.source) = 4 THEN 'clauses' ELSE 'unknown' END AS route
 FROM benchmark q LEFT JOIN hy h ON q.item_id = h.qid AND h.rank = 1 LEFT JOIN documents d ON d.doc_id = h.docid""")
def _(t):
    dense, sparse = service_runs(t)
    return J.faq_match(t.topics, dense, sparse, faq(t), containment_judge)


@register("faq_match_rerank", f"""WITH {HYBRID}, j AS (SELECT h.qid, h.docid, d.text AS question, d.source AS answer, round(len(list_intersect({WORDS.format(c='b.text')}, {WORDS.format(c='d.text')})) / len({WORDS.format(c='b.text')}), 6) AS score
 FROM hy h JOIN documents d ON d.doc_id = h.docid JOIN benchmark b ON b.item_id = h.qid), r AS ({S.ranked('j', 1)}) SELECT qid, docid, question, answer, score FROM r""")
def _(t):
    dense, sparse = service_runs(t)
    return J.faq_match_rerank(t.topics, dense, sparse, faq(t))


def first_words():
    return lambda prompt: " ".join(prompt.split(" ")[:6])


def echo_length():
    return lambda prompt: str(len(prompt))


@register("clause_search", "WITH bm AS (SELECT 1), benchmark6 AS (SELECT item_id, array_to_string(string_split(text, ' ')[1:6], ' ') AS text FROM benchmark), "
          + S.bm25("run", 3, 0.82, 0.68, True).replace("FROM benchmark", "FROM benchmark6")
          + """, c AS (SELECT r.qid, string_agg(r.docid::VARCHAR, ' ' ORDER BY r.rank) AS docids, string_agg('条款' || r.rank || '：' || chr(10) || d.text, chr(10) ORDER BY r.rank) AS ctx FROM run r JOIN documents d ON d.doc_id = r.docid GROUP BY r.qid)
 SELECT b.item_id AS qid, coalesce(docids, '') AS docids, length('问题：' || chr(10) || b.text || chr(10) || coalesce(ctx, ''))::VARCHAR AS answer FROM benchmark b LEFT JOIN c ON b.item_id = c.qid""")
def _(t):
    index = L.build_index(t.corpus)
    search = lambda q: J.batch_retrieve(index, None, q, 3)
    out = J.clause_search(t.topics, first_words, search, t.corpus, echo_length)
    return out.select("qid", F.array_join(F.transform("docids", lambda d: d.cast("string")), " ").alias("docids"), "answer")


def first_by_vectors(t, queries):
    """Dense run of the vectors that carry the questions' ids."""
    q = t.embeddings.join(queries.select(F.col("qid").alias("vec_id")), "vec_id").select(F.col("vec_id").alias("qid"), "embedding")
    return D.dense_search(q, t.vec_corpus, 20)


def lexical_and_dense(t, index, k):
    """Hybrid search of ``(qid, query)``: BM25 of the text, vectors of the ids."""
    return lambda q: X.hybrid_search(first_by_vectors(t, q), L.bm25_search(index, q, 20, **APP_BM25), J.ALPHA, k)


def hybrid_sql(name, k, queries="benchmark"):
    return f"""{S.bm25(name + '_lex', 20, 0.82, 0.68, True, queries=queries)},
 {name}_vec AS (SELECT a.vec_id AS qid, b.vec_id AS docid, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score FROM embeddings a CROSS JOIN embeddings b WHERE a.vec_id IN (SELECT item_id FROM {queries})),
 {name}_den AS ({S.ranked(name + '_vec', 20)}),
 {name}_pair AS (SELECT coalesce(l.qid, d.qid) AS qid, coalesce(l.docid, d.docid) AS docid, d.score AS d, l.score AS s FROM {name}_lex l FULL JOIN {name}_den d ON l.qid = d.qid AND l.docid = d.docid),
 {name}_sum AS (SELECT qid, docid, round(0.3e0 * coalesce(s, min(s) OVER (PARTITION BY qid), 0) + coalesce(d, min(d) OVER (PARTITION BY qid), 0), 8) AS score FROM {name}_pair),
 {name} AS ({S.ranked(name + '_sum', k)})"""


@register("hybrid_lexical_dense", f"WITH {hybrid_sql('hy', 10)} SELECT * FROM hy")
def _(t):
    return lexical_and_dense(t, L.build_index(t.corpus), 10)(t.topics)


@register("question_turn", f"""WITH consult AS (SELECT item_id, text FROM benchmark WHERE item_id % 5 NOT IN (0, 4)), {hybrid_sql('fq', 1, 'consult')},
 judged AS (SELECT c.item_id, c.text, f.docid, d.text AS question, d.source AS known, CASE WHEN f.docid IS NULL THEN 'clauses' WHEN contains(d.text, c.text) THEN 'answered' WHEN length(d.source) = 4 THEN 'clauses' ELSE 'unknown' END AS route
   FROM consult c LEFT JOIN fq f ON f.qid = c.item_id LEFT JOIN documents d ON d.doc_id = f.docid),
 opened AS (SELECT item_id, array_to_string(string_split(text, ' ')[1:6], ' ') AS text, text AS query FROM judged WHERE route = 'clauses'), {hybrid_sql('cl', 3, 'opened')},
 context AS (SELECT c.qid, list(c.docid ORDER BY c.rank) AS docids, string_agg('条款' || c.rank || '：' || chr(10) || d.text, chr(10) ORDER BY c.rank) AS ctx FROM cl c JOIN documents d ON d.doc_id = c.docid GROUP BY c.qid)
 SELECT item_id AS qid, CASE WHEN item_id % 5 = 0 THEN 'chat' ELSE 'human' END AS route, '' AS docids, NULL AS matched, CASE WHEN item_id % 5 = 0 THEN length('turn ' || item_id || chr(10) || text)::VARCHAR END AS answer FROM benchmark WHERE item_id % 5 IN (0, 4)
 UNION ALL SELECT item_id, route, docid::VARCHAR, question, CASE WHEN route = 'answered' THEN known END FROM judged WHERE route <> 'clauses'
 UNION ALL SELECT o.item_id, 'clauses', coalesce(array_to_string(x.docids, ' '), ''), NULL, length('问题：' || chr(10) || o.query || chr(10) || coalesce(x.ctx, ''))::VARCHAR FROM opened o LEFT JOIN context x ON x.qid = o.item_id""")
def _(t):
    index = L.build_index(t.corpus)
    last = F.col("qid") % 5
    classify = lambda q: q.withColumn("probabilities", F.array(F.when(last == 0, 0.9).otherwise(0.1), F.lit(0.5), F.when(last == 4, 0.8).otherwise(0.2)))
    service = Service(classify, echo_length, lexical_and_dense(t, index, 1), containment_judge, first_words, lexical_and_dense(t, index, 3), echo_length)
    history = t.topics.select("qid", F.concat(F.lit("turn "), "qid").alias("history"))
    out = question_turn(t.topics, faq(t), t.corpus, service, history)
    return out.withColumn("docids", F.array_join(F.transform("docids", lambda d: d.cast("string")), " "))


@register("intent_routes", """WITH p AS (SELECT doc_id, [0.4e0 - 0.1e0 * quality, 0.3e0 + 0.1e0 * quality, 0.25e0 + 0.3e0 * toxic] AS p FROM labels), l AS (SELECT doc_id, list_position(p, list_max(p)) - 1 AS label FROM p)
 SELECT CASE label WHEN 0 THEN 'chat' WHEN 1 THEN 'consult' ELSE 'human' END AS route, count(*) AS n FROM l GROUP BY route""")
def _(t):
    p = F.array(0.4 - 0.1 * F.col("quality"), 0.3 + 0.1 * F.col("quality"), 0.25 + 0.3 * F.col("toxic"))
    return J.route_by_intent(t.labels.select("doc_id", p.alias("p")), "p").groupBy("route").agg(F.count(F.lit(1)).alias("n"))


@register("intent_classifier")
def _(t):
    label = F.when(F.col("toxic") == 1, 2).when(F.col("quality") == 1, 1).otherwise(0)
    rows = t.documents.join(t.labels, "doc_id").select("doc_id", F.col("text").alias("sentence"), label.alias("label"))
    return J.evaluate_intents(split_by_ratio(rows, "doc_id", 0.2))


@register("batch_retrieve_vectors", f"WITH {S.dense('run', 5, skip_self=False)} SELECT * FROM run")
def _(t):
    return J.batch_retrieve(None, t.vec_corpus, t.vec_queries, 5)


@register("two_stage_retrieval")
def _(t):
    enc = K.hashing_encoder(128)
    q = K.embed(t.topics, "query", enc).select("qid", "embedding")
    d = K.embed(t.corpus, "text", enc).select("docid", "embedding")
    return J.two_stage(L.build_index(t.corpus), t.topics, q, d, 50, 5)


@register("evaluate_and_collate", f"""WITH {S.bm25('run', 20)}, {S.QRELS}, n AS (SELECT qid, count(*) AS n_rel FROM qrels GROUP BY qid),
 h AS (SELECT r.qid, min(r.rank) AS first FROM run r JOIN qrels q ON q.qid = r.qid AND q.docid = r.docid WHERE rank <= 10 GROUP BY r.qid)
 SELECT 'mrr@10' AS metric, round(avg(coalesce(1 / h.first, 0)), 6) AS value FROM (SELECT DISTINCT qid FROM run) LEFT JOIN h USING (qid)""")
def _(t):
    out = J.evaluate_and_collate(bm25_run(t, 20), t.topics, t.corpus, E.phrase_matches(t.corpus, t.topics), [10], 5)
    return out["metrics"].filter("metric = 'mrr@10'")


def stream(t, table):
    schema = t.spark.read.parquet(f"{t.folder}/{table}.parquet").schema
    return t.spark.readStream.schema(schema).option("pathGlobFilter", f"{table}.parquet").parquet(t.folder)


def shuffled_files(t, rows, name, files, *keys):
    """``rows`` as files in an order that has nothing to do with theirs, read one file in a micro-batch."""
    path = scratch_path(t.spark, name)
    rows.repartition(files, F.xxhash64(*keys)).write.parquet(path)
    return t.spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)


@register("stream_of_queries", f"WITH {S.bm25('run', 10, 0.82, 0.68, True)} SELECT * FROM run")
def _(t):
    out, check = scratch_path(t.spark, "answers"), scratch_path(t.spark, "state")
    arriving = shuffled_files(t, t.topics, "topics", 3, "qid")
    St.answer_stream(arriving, L.build_index(t.corpus), out, check, 10, k1=0.82, b=0.68, length_norm=True).awaitTermination()
    return t.spark.read.parquet(out).drop("batch")


@register("stream_of_documents", f"WITH {S.bm25('run', 10)} SELECT * FROM run")
def _(t):
    """Every tenth document arrives twice, first with another text."""
    out, check = scratch_path(t.spark, "parts"), scratch_path(t.spark, "state")
    path = scratch_path(t.spark, "document-files")
    old = t.corpus.filter("docid % 10 = 3").select("docid", F.reverse("text").alias("text"))
    for rows, files in ((old, 1), (t.corpus, 4)):  # the second start goes on where the first ended
        rows.repartition(files, F.xxhash64("docid")).write.mode("append").parquet(path)
        arriving = t.spark.readStream.schema(t.corpus.schema).option("maxFilesPerTrigger", 1).parquet(path)
        St.index_stream(arriving, out, check).awaitTermination()
    return L.bm25_search(St.load_streamed_index(t.spark, out), t.topics, 10)


@register("stream_of_turns", "SELECT conv_id, turn, string_agg(text, chr(10)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS history FROM conversations")
def _(t):
    out, check = scratch_path(t.spark, "history"), scratch_path(t.spark, "state")
    turns = shuffled_files(t, t.conversations.select("conv_id", "turn", "text"), "turns", 4, "conv_id", "turn")
    St.history_stream(turns, 3, out, check).awaitTermination()
    return St.read_history(t.spark, out)
