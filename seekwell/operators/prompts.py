"""Prompt assembly: instructions, scoring prompts, chat rows, few-shot, probes, templates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from seekwell.functions.text import fill_template, tokens, truncate, truncate_left_of_pair
from seekwell.scale import BROADCAST_BYTES, cut, hash_rank, running_totals, seeded, seeded_place, top_rows

# Instruction in front of queries and keys, by instruction family and task.
INSTRUCTIONS = {
    "by_task": {
        "qa": ("Represent this query for retrieving relevant documents: ", "Represent this document for retrieval: "),
        "convsearch": ("Encode this query and context for searching relevant passages: ", "Encode this passage for retrieval: "),
        "chat": ("Embed this dialogue to find useful historical dialogues: ", "Embed this historical dialogue for retrieval: "),
        "lrlm": ("Embed this text chunk for finding useful historical chunks: ", "Embed this historical text chunk for retrieval: "),
        "icl": ("Convert this example into vector to look for useful examples: ", "Convert this example into vector for retrieval: "),
        "tool": ("Transform this user request for fetching helpful tool descriptions: ", "Transform this tool description for retrieval: "),
    },
    "sentence": {"*": ("Represent this sentence for searching relevant passages: ", "")},
    "query_passage": {"*": ("query: ", "passage: ")},
    "duplicate": {
        "qa": ("Represent the query for retrieving supporting documents: ", "Represent the document for retrieval: "),
        "convsearch": ("Represent the query and context for retrieving supporting passages: ", "Represent the passage for retrieval: "),
        "chat": ("Represent the dialogue for retrieving useful historical dialogues: ", "Represent the historical dialogue for retrieval: "),
        "lrlm": ("Represent the text chunk for retrieving useful historical chunks: ", "Represent the historical text chunk for retrieval: "),
        "icl": ("Represent the example for retrieving duplicate examples: ", "Represent the example for retrieval: "),
        "tool": ("Represent the user request for retrieving duplicate examples: ", "Represent the tool description for retrieval: "),
    },
}
# Layouts of scored, question, choice and chat prompts.
SCORE_TEMPLATES = {
    "qa": "Knowledge: {key}\n\nQuestion: {query}\n\nAnswer: {answer}",
    "convsearch": "Knowledge: {key}\n\nQuestion: {query}\n\nAnswer: {answer}",
    "icl": "{key}\n{query}\n{answer}",
    "chat": "{key}\nSpeaker 1: {query}\nSpeaker 2: {answer}",
}
STRIPPED_TASKS = ("qa", "convsearch")
CHOICE_HEAD = "The following are multiple choice questions (with answers) about {subject}.\n\n"
LETTERS = ("A", "B", "C", "D")
# The texts around a hidden fact.
PROBE_HEAD = ("There is an important infomation hidden in the following context. Find the information and memorize it. "
              "I will quiz you about the important information there.\n")
PASSKEY_FACT = "\n\nThe pass key is {passkey}. Remember it. {passkey} is the pass key.\n\n"
PASSKEY_ASK = "\n\nWhat is the pass key?"


def instruction(family: str, task: Column, side: str) -> Column:
    """Instruction text by task, from the fixed table of the family."""
    at = {"query": 0, "key": 1}[side]
    table = INSTRUCTIONS[family]
    if "*" in table:
        return F.lit(table["*"][at])
    return F.element_at(F.create_map(*[F.lit(x) for t, pair in table.items() for x in (t, pair[at])]), task)


def with_instructions(df: DataFrame, family: str) -> DataFrame:
    """Prefix ``query`` and ``key`` by the row's ``task``."""
    return (df.withColumn("query", F.concat(instruction(family, F.col("task"), "query"), "query"))
            .withColumn("key", F.concat(instruction(family, F.col("task"), "key"), "key")))


def score_prompts(df: DataFrame, key_max: int, seed: int = 42, tokenizer="whitespace") -> DataFrame:
    """One prompt per candidate key of ``(qid, task, query, keys, answers)`` with one seeded
    answer and the key cut to ``key_max`` tokens."""
    digest = F.conv(F.substring(seeded(seed, F.col("qid").cast("string")), 1, 8), 16, 10).cast("long")
    answer = F.get("answers", (digest % F.greatest(F.size("answers"), F.lit(1))).cast("int"))
    rows = df.withColumn("answer", answer).select("qid", "task", "query", "answer", F.posexplode("keys").alias("key_index", "key"))
    rows = rows.withColumn("key", F.array_join(truncate(tokens("key", tokenizer), key_max), " "))
    strip = lambda c: F.when(F.col("task").isin(*STRIPPED_TASKS), F.trim(c)).otherwise(F.col(c))
    rows = rows.select("qid", "task", "key_index", strip("query").alias("query"), strip("key").alias("key"), strip("answer").alias("answer"))
    prompt = F.lit(None).cast("string")
    for task, template in SCORE_TEMPLATES.items():
        prompt = F.when(F.col("task") == task, fill_template(template)).otherwise(prompt)
    return rows.select("qid", "task", "key_index", prompt.alias("prompt"))


def chat_rows(turns: DataFrame, min_length: int, max_length: int, expect_answer: bool = False, tokenizer="whitespace") -> DataFrame:
    """One prompt per conversation, ``role: text`` lines.

    A leading turn that is not from the user is dropped. ``expect_answer`` keeps the first
    turn as prompt and the second as ``answer``. Conversations outside the length range go
    before anything is collected, so a collected conversation holds at most ``max_length``
    tokens. ``alternates`` tells whether the roles take turns.
    """
    first = turns.groupBy("conv_id").agg(F.min_by("role", "turn").alias("_r"), F.min("turn").alias("_t"))
    skip = (F.col("turn") == F.col("_t")) & (F.col("_r") != "user")
    line = F.concat(F.col("role"), F.lit(": "), F.col("text"))
    rows = turns.join(first, "conv_id").filter(~skip).withColumn("_line", line).withColumn("_n", F.size(tokens("_line", tokenizer)))
    start = F.col("_t") + F.when(F.col("_r") != "user", F.lit(1)).otherwise(F.lit(0))
    if expect_answer:
        rows = rows.withColumn("_at", F.col("turn") - start).filter(F.col("_at") <= 1)
        rows = rows.withColumn("_n", F.when(F.col("_at") == 0, F.col("_n")).otherwise(F.lit(0)))
    sizes = rows.groupBy("conv_id").agg(F.sum("_n").alias("length")).filter(F.col("length").between(min_length, max_length))
    kept = rows.join(sizes, "conv_id")
    if expect_answer:
        return kept.groupBy("conv_id", "length").agg(
            F.max(F.when(F.col("_at") == 0, F.col("_line"))).alias("prompt"), F.max(F.when(F.col("_at") == 1, F.col("text"))).alias("answer"))
    before = F.lag("role").over(W.partitionBy("conv_id").orderBy("turn"))
    kept = kept.withColumn("_same", F.coalesce(before == F.col("role"), F.lit(False)))
    lines = F.array_sort(F.collect_list(F.struct("turn", "_line")))
    out = kept.groupBy("conv_id", "length").agg(lines.alias("_l"), (~F.max("_same")).alias("alternates"))
    return out.select("conv_id", "length", F.array_join(F.transform("_l", lambda x: x["_line"]), "\n").alias("prompt"), "alternates")


def same_task_first(run: DataFrame, query_tasks: DataFrame, doc_tasks: DataFrame, k: int) -> DataFrame:
    """Nearest examples of the query's task, then the nearest of other tasks."""
    rows = run.select("qid", "docid", F.col("rank").alias("hit_rank")).join(query_tasks, "qid").join(doc_tasks.withColumnRenamed("task", "_d"), "docid")
    rows = rows.withColumn("_other", (F.col("task") != F.col("_d")).cast("int"))
    return top_rows(rows, ["qid"], [F.col("_other"), F.col("hit_rank")], k).select("qid", "docid", "rank")


def same_task_random(queries: DataFrame, docs: DataFrame, k: int, seed: int = 42) -> DataFrame:
    """``k`` seeded examples of the query's task: every task has one seeded order and a query
    reads ``k`` places of it, wrapping around."""
    order = hash_rank(docs.select("docid", "task").withColumn("_h", seeded(seed, "docid")), ["task"], "_h", ["docid"], "_pos").select("docid", "task", "_pos")
    sizes = docs.groupBy("task").agg(F.count(F.lit(1)).alias("_n"))
    start = seeded_place(seed, "qid")
    wanted = (queries.select("qid", "task").join(sizes, "task")
              .withColumn("rank", F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.lit(k), F.col("_n")))))
              .withColumn("_pos", (start + F.col("rank")) % F.col("_n") + 1))
    return wanted.join(order, ["task", "_pos"]).select("qid", "docid", "rank")


# Examples of one block of the pool.
POOL_BLOCK = 1_000


def other_property_examples(queries: DataFrame, examples: DataFrame, per_property: int, seed: int = 42) -> DataFrame:
    """Seeded examples of every property except the query's own.

    The pool has ``per_property`` rows per property, in one order by property and rank, so all but the query's own are two
    ranges of places. The pool is dealt into blocks of ``POOL_BLOCK`` places; a query meets every block that is not wholly
    its own property. Rows without a property take no part. Blocks travel to the queries when their measured size allows, otherwise queries are salted.
    """
    pool = top_rows(examples.filter("prop is not null").select("prop", "id", seeded(seed, "id").alias("_h")), ["prop"], [F.col("_h"), F.col("id")], per_property).drop("_h")
    placed = cut(running_totals(pool, [], "prop", {"_place": F.lit(1).cast("long")}, ["rank", "id"]), "pool")
    own = placed.groupBy("prop").agg(F.min("_place").alias("_lo"), F.max("_place").alias("_hi"))
    block = F.floor((F.col("_place") - 1) / POOL_BLOCK)
    blocks = placed.groupBy(block.alias("_block")).agg(F.collect_list(F.struct("_place", "prop", "rank", "id")).alias("_rows"))
    size = placed.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length(F.col("prop").cast("string")) + F.octet_length(F.col("id").cast("string")) + 40), F.lit(0)).alias("bytes")).first()
    last = F.lit(max(size["n"] - 1, 0) // POOL_BLOCK)
    asked = queries.filter("prop is not null").select("qid", "prop").join(own, "prop", "left").withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), last.cast("long"))))
    inside = (F.col("_block") * POOL_BLOCK + 1 >= F.col("_lo")) & ((F.col("_block") + 1) * POOL_BLOCK <= F.col("_hi"))
    asked = asked.filter(~F.coalesce(inside, F.lit(False)))
    if size["bytes"] <= BROADCAST_BYTES:
        met = asked.join(F.broadcast(blocks), "_block")
    else:
        salts = int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        salted = blocks.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        met = asked.withColumn("_salt", F.pmod(F.xxhash64("qid"), F.lit(salts)).cast("int")).join(salted, ["_block", "_salt"])
    others = F.filter("_rows", lambda e: F.coalesce((e["_place"] < F.col("_lo")) | (e["_place"] > F.col("_hi")), F.lit(True)))
    return met.select("qid", F.explode(others).alias("e")).select("qid", F.col("e.prop").alias("prop"), F.col("e.rank").alias("rank"), F.col("e.id").alias("docid"))


def fitting_prefix(items: Column, budget: Column, tokenizer="whitespace") -> Column:
    """Leading items whose summed length stays within ``budget``. Few-shot lists are short."""
    sizes = F.transform(items, lambda x: F.size(tokens(x, tokenizer)))
    upto = lambda i: F.aggregate(F.slice(sizes, 1, i + 1), F.lit(0), lambda a, b: a + b)
    return F.filter(items, lambda x, i: upto(i) <= budget)


def qa_prompt(query: Column, keys: Column, shots: Column, limit: int, key_num: int = 3) -> Column:
    """Knowledge, worked examples and question; examples must fit beside the question and
    the knowledge is shortened to the room that is left."""
    question = F.concat(F.lit("Question: "), F.trim(query), F.lit("\nAnswer:"))
    room = F.lit(limit) - F.size(tokens(question))
    worked = F.array_join(F.transform(fitting_prefix(shots, room), lambda s: F.concat(s, F.lit("\n\n"))), "")
    right = F.concat(F.lit("\n\n"), worked, question)
    left = F.when(F.size(keys) > 0, F.concat(F.lit("Knowledge: "), F.array_join(F.slice(keys, 1, key_num), "\n"))).otherwise(F.lit(""))
    kept = F.array_join(truncate_left_of_pair(tokens(left), tokens(right), limit), " ")
    return F.regexp_replace(F.concat(kept, right), r"^\s+|\s+$", "")


def choice_sample(query: Column, choices: Column, answer) -> Column:
    lines = F.transform(F.arrays_zip(F.array(*[F.lit(x) for x in LETTERS]).alias("l"), choices.alias("c")), lambda z: F.concat(z["l"], F.lit(". "), z["c"]))
    return F.concat(query, F.lit("\n"), F.array_join(lines, "\n"), F.lit("\nAnswer: "), answer)


def choice_prompts(df: DataFrame, limit: int, key_num: int = 3) -> DataFrame:
    """``(qid, subject, query, choices, keys, shots)`` to one prompt per option, the knowledge
    cut to the room the question leaves."""
    head = F.replace(F.lit(CHOICE_HEAD), F.lit("{subject}"), F.translate("subject", "_", " "))
    worked = F.array_join(F.transform("shots", lambda s: F.concat(s, F.lit("\n\n"))), "")
    fixed = F.concat(head, worked)
    room = F.lit(limit) - F.size(tokens(F.concat(fixed, choice_sample(F.trim("query"), F.col("choices"), F.lit("A")))))
    known = F.concat(F.lit("Knowledge:\n"), F.array_join(F.slice("keys", 1, key_num), "\n"))
    known = F.when((F.size("keys") > 0) & (room >= 0), F.array_join(F.slice(tokens(known), F.lit(1), F.greatest(room, F.lit(0))), " ")).otherwise(F.lit(""))
    rows = df.withColumn("_k", known).withColumn("_f", fixed).withColumn("option", F.explode(F.array(*[F.lit(x) for x in LETTERS])))
    left = F.when(F.col("_k") != "", F.concat("_k", F.lit("\n\n"))).otherwise(F.lit(""))
    text = F.concat(left, "_f", choice_sample(F.trim("query"), F.col("choices"), F.col("option")))
    return rows.select("qid", "option", F.array_join(truncate(tokens(text), limit, "tail"), " ").alias("prompt"))


def few_shot_prompt(query: Column, shots: Column, limit: int, count: int) -> Column:
    """Examples in reverse order while they fit beside the query, then the query."""
    room = F.lit(limit) - F.size(tokens(query))
    kept = F.slice(fitting_prefix(F.reverse(shots), room), 1, count)
    return F.concat(F.array_join(F.concat(kept, F.array(query)), "\n"), F.lit("\n"))


def passkey(key: Column, digits: int, seed: int = 42) -> Column:
    """Seeded number with ``digits`` digits."""
    draw = F.conv(F.substring(seeded(seed, key.cast("string")), 1, 12), 16, 10).cast("long")
    return (draw % (9 * 10 ** (digits - 1)) + 10 ** (digits - 1)).cast("string")


def insert_probes(docs: DataFrame, lengths: list[int], depths: list[int], fact: Column, ask: str, tokenizer="whitespace") -> DataFrame:
    """Hide ``fact`` at every depth percentage of a context of every length.

    The text is repeated when it is shorter than the length.
    """
    head, tail = tokens(F.lit(PROBE_HEAD), tokenizer), tokens(F.lit(ask), tokenizer)
    rows = docs.select("doc_id", tokens("text", tokenizer).alias("_t"), tokens(fact, tokenizer).alias("_f"))
    rows = (rows.withColumn("length", F.explode(F.array(*[F.lit(x) for x in lengths])))
            .withColumn("depth", F.explode(F.array(*[F.lit(x) for x in depths]))))
    low = F.size(head)
    high = F.col("length") - F.size(tail) - F.size("_f") - 1
    at = (low + F.bround((high - low) * F.col("depth") / 100, 0)).cast("int")
    room = F.greatest(F.col("length") - F.size(head) - F.size("_f") - F.size(tail), F.lit(0))
    filler = F.slice(F.flatten(F.array_repeat(F.col("_t"), F.ceil(F.col("length") / F.size("_t")).cast("int"))), F.lit(1), room)
    out = rows.filter(high >= low).withColumn("_c", filler).withColumn("_at", at)
    body = F.concat(head, F.slice("_c", F.lit(1), F.col("_at")), F.col("_f"), F.slice("_c", F.col("_at") + 1, F.size("_c")), tail)
    return out.select("doc_id", "length", "depth", F.array_join(body, " ").alias("prompt"))


def render_templates(df: DataFrame, templates: dict[str, str], limit: int | None = None) -> DataFrame:
    """Fill ``{context}`` and ``{input}`` of the row's dataset template; a prompt longer than
    ``limit`` tokens loses its middle."""
    prompt = F.lit(None).cast("string")
    for dataset, template in templates.items():
        prompt = F.when(F.col("dataset") == dataset, fill_template(template)).otherwise(prompt)
    out = df.withColumn("prompt", prompt)
    return out if limit is None else out.withColumn("prompt", F.array_join(truncate(tokens("prompt"), limit, "middle"), " "))


def choice_gold(answer: Column, options: Column) -> Column:
    """Right option text and its letter."""
    at = F.array_position(options, answer).cast("int")
    return F.when(at > 0, F.array(answer, F.get(F.array(*[F.lit(x) for x in LETTERS]), at - 1)))


# A function call in a code question, the number a list question asks for, and tasks with option letters.
CALL = r"func_[0-9]+\(-?[0-9]+\)"
ASKED_NUMBER = r"The .+ of"
OPTION_TASKS = ("code_debug", "longbook_choice_eng")


def derived_fields(df: DataFrame) -> DataFrame:
    """Template fields that follow from ``input``, ``options`` and ``content``: ``question``, ``func`` and ``func_call`` (the
    first call in the input), ``prefix`` (the question for the number that the input names) and ``OPTION_A`` to ``OPTION_D``.
    ``context`` falls back to ``content``. A field that does not apply is null."""
    call = F.regexp_extract("input", f"({CALL})", 1)
    asked = F.regexp_extract("input", f"({ASKED_NUMBER})", 1)
    some = lambda value, when: F.when(when != "", value)
    number = F.lower(F.expr("substring(_asked, 1, length(_asked) - 3)"))
    out = df.withColumn("_asked", asked)
    fields = {
        "question": F.col("input"), "func_call": some(call, call), "func": some(F.split(call, "\\(")[0], call),
        "prefix": some(F.concat(F.lit("What is "), number, F.lit(" in the following list?")), F.col("_asked")),
    }
    if "content" in df.columns:
        fields["context"] = F.coalesce("context", "content") if "context" in df.columns else F.col("content")
    options = F.col("options") if "options" in df.columns else F.array().cast("array<string>")
    fields |= {f"OPTION_{x}": F.get(options, i) for i, x in enumerate(LETTERS[:4])}
    return out.withColumns(fields).drop("_asked")


def gold_answers(task: Column, answer: Column, options: Column) -> Column:
    """``answer`` (an array) as it is scored. Tasks with option letters need the text and its letter: a single text gets
    the letter of its place in ``options``, a pair must end in a letter; anything else is null."""
    letters = F.array(*[F.lit(x) for x in LETTERS[:4]])
    first, second = F.get(answer, 0), F.get(answer, 1)
    at = F.array_position(options, first).cast("int")
    alone = F.when(at > 0, F.array(first, F.get(letters, at - 1)))
    pair = F.when(F.array_contains(letters, second), answer)
    return F.when(task.isin(*OPTION_TASKS), F.when(F.size(answer) == 1, alone).when(F.size(answer) == 2, pair)).otherwise(answer)


def explode_options(df: DataFrame, options: str = "options", choice: str = "choice") -> DataFrame:
    """One row per option with its place ``pos``; rows without options go."""
    others = [c for c in df.columns if c != options]
    return df.select(*others, F.posexplode(options).alias("pos", choice))


def few_counts(df: DataFrame, column: str, allowed: list) -> DataFrame:
    """Evaluation rows whose number of topics or lines is one of ``allowed``; none allowed keeps all."""
    return df.filter(F.col(column).isin(list(allowed))) if allowed else df
