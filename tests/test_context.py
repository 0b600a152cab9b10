"""Search inside groups with one large group, and models that answer batches."""

import random

import pytest

from seekwell.operators import context as C
from seekwell.operators.hooks import generate


def test_large_group_is_salted_and_equal(spark, monkeypatch):
    rnd = random.Random(3)
    items = [("big" if i % 3 else f"g{i % 30}", i, ["the"] + [f"t{rnd.randint(0, 9)}" for _ in range(rnd.randint(1, 6))]) for i in range(400)]
    queries = [(g, q, ["the", f"t{q}", "t5"]) for g in ("big", "g0", "g3") for q in (1, 2)]
    i, q = spark.createDataFrame(items, "grp string, item long, toks array<string>"), spark.createDataFrame(queries, "grp string, q int, toks array<string>")
    key = lambda df: sorted((r.grp, r.q, r.item, r.score, r["rank"]) for r in df.collect())
    want = key(C.local_bm25(i, q, 7))
    monkeypatch.setattr(C, "ROWS_PER_SALT", 20)
    got = C.local_bm25(i, q, 7)
    assert "_salt" in got._jdf.queryExecution().executedPlan().toString() and key(got) == want and len(want) > 30


def model(path, broken):
    """A factory whose class travels by value, as a user's own would from a notebook."""
    class Model:
        def __call__(self, prompt):
            with open(f"{path}/single", "a") as log:
                log.write("x")
            return prompt.upper()

        def batch(self, prompts):
            with open(f"{path}/batch", "a") as log:
                log.write("x")
            if broken:
                raise RuntimeError
            return [p.upper() for p in prompts]

    return Model


@pytest.mark.parametrize("broken", [False, True])
def test_batches_of_prompts(spark, tmp_path, broken):
    df = spark.range(20).selectExpr("id", "concat('p', id) as prompt").coalesce(1)
    out = generate(df, "prompt", model(str(tmp_path), broken), batch_size=8).collect()
    assert {r.id: r.answer for r in out} == {i: f"P{i}" for i in range(20)}
    assert len((tmp_path / "batch").read_text()) == 3 and (tmp_path / "single").exists() == broken
