"""Bare secrets of every length and shape that fit a learned format."""

import random
import tracemalloc

import pyarrow as pa

from seekwell.llm import secrets

from .fixtures import documents, prose

HEX, UPPER = "0123456789abcdef", "BCDFGHJKLMNPQRSTVWXZ"


def test_short_dotted_and_digit_free_runs(spark):
    rnd = random.Random(8)
    draw = lambda letters, n: "".join(rnd.choice(letters) for _ in range(n))
    words = ["".join(rnd.choice("aeinorst") for _ in range(rnd.randint(8, 14))) for _ in range(200)]
    rows = []
    for i in range(150):  # one format without digits, plain or dotted, and one of hexadecimal digits
        value = draw(UPPER, 24) if i % 3 else f"{draw(UPPER, 12)}.{draw(UPPER, 12)}"
        rows.append((i, f"{prose(i, 12)} {' '.join(rnd.sample(words, 12))}. token = \"{value}\" {prose(i + 1, 5)} {draw(HEX, 32)} x"))
    planted = {f"a{draw(HEX, n - 2)}7": n for n in range(8, 16)}  # a letter and a digit at least
    planted |= {draw(UPPER, n): n for n in (9, 12, 20)}
    planted[f"{draw(UPPER, 12)}.{draw(UPPER, 12)}"] = 25
    for k, value in enumerate(planted):
        rows.append((1000 + k, f"before {value} after"))
        rows.append((2000 + k, f"it ends the sentence: {value}."))
    plain = ["20240117", "4379362835490466", "555-3824-1177", "152.143.123.131", "sentence.Another", "www.example.com", "well-known/unknown", *words[:20]]
    rows += [(3000 + k, f"before {value} after") for k, value in enumerate(plain)]
    got = {r.doc_id: r.spans for r in secrets.digest(secrets.find_secrets(documents(spark, rows))).collect()}
    found = {v: got[1000 + k] == f"format:7:{7 + len(v)}" and got[2000 + k] == f"format:22:{22 + len(v)}" for k, v in enumerate(planted)}
    assert all(found.values()), [v for v, ok in found.items() if not ok]
    assert not [v for k, v in enumerate(plain) if got[3000 + k]]
    assert not [i for i in range(150) if "format" in got[i]]


def test_part_of_a_dotted_run(spark):
    rnd = random.Random(9)
    rows = [(i, f"token = {''.join(rnd.choice(HEX) for _ in range(40))}") for i in range(60)]
    key = "".join(rnd.choice(HEX) for _ in range(26))
    rows.append((900, f"see settings.production.{key}.zip."))
    got = {r.doc_id: r.spans for r in secrets.digest(secrets.find_secrets(documents(spark, rows))).collect()}
    assert got[900] == f"format:24:{24 + len(key)}"


def test_words_are_not_secrets_beside_random_passwords(spark):
    """With passwords of any letters among the examples, ordinary words stay words, shouted or not, and most keys are found."""
    rnd = random.Random(10)
    any_ = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    syllables = ["be", "en", "ble", "ed", "ing", "the", "ation", "de", "er", "ach", "ein"]
    vocabulary = ["".join(rnd.choice(syllables) for _ in range(rnd.randint(4, 6))) for _ in range(300)]
    rows = [(i, " ".join(rnd.choice(vocabulary) for _ in range(30)) + " " + rnd.choice(vocabulary).upper()) for i in range(400)]
    rows += [(1000 + i, f"password={''.join(rnd.choice(any_) for _ in range(24))} {''.join(rnd.choice(vocabulary))}") for i in range(120)]
    keys = [(2000 + i, "".join(rnd.choice(any_) for _ in range(8 + i % 33))) for i in range(100)]
    rows += [(d, f"note {k} end") for d, k in keys]
    got = {r.doc_id: r.spans for r in secrets.digest(secrets.find_secrets(documents(spark, rows))).collect()}
    assert not [i for i in range(400) if got[i]] and not [i for i in range(1000, 1120) if "format" in got[i]]
    assert sum(got[d] == f"format:5:{5 + len(k)}" for d, k in keys) >= 80


def test_all_ordinary_words_count(spark):
    """More words than any fixed number: each counts in the null model and for the border; before, 4,000 of them did."""
    rnd = random.Random(11)
    words = sorted({"".join(rnd.choice("aeinorst") for _ in range(rnd.randint(8, 12))) for _ in range(6000)})
    slim = spark.createDataFrame([([(0, 1, w) for w in words[at:at + 100]] + [(0, 1, f"once{'x' * (at // 100 + 4)}")],) for at in range(0, len(words), 100)] * 2 + [([(0, 1, "onlyhere"), (0, 1, "onlyhere")],)],
                                 "candidates array<struct<start:int,end:int,value:string>>").repartition(5)
    found = secrets.ordinary_words(slim)
    got = sorted(r.word for r in found.collect() if not r.word.startswith("once"))
    assert got == words and len(words) > 5000
    null = secrets.null_model(found)
    assert null.passed[0] == sum(null.seen[0].values()) == found.count() == sum(null.ended)
    automaton = secrets.Automaton(sorted("".join(rnd.choice("abcdefnrst") for _ in range(16)) for _ in range(50)))
    reached = sorted(automaton.score(r.word) for r in found.collect())
    exact = reached[int((1 - secrets.LIKE_WORDS) * len(reached))]
    assert exact <= secrets.borders(found, [automaton])[0] < exact + secrets.STEP + 1e-9
    assert secrets.borders(found.limit(0), [automaton]) == [float("-inf")]


SLIM = pa.schema([("doc_id", pa.struct([("_k1", pa.int64()), ("_k2", pa.int64())])),
                  ("base", pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))),
                  ("candidates", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("value", pa.string())])))])


class Long:
    """A format that every value of 12 or more letters fits."""

    def fits(self, value):
        return len(value) >= 12


def test_candidates_stay_in_arrow():
    """Before, all candidates of a batch became Python objects at once, whatever their number."""
    rnd = random.Random(12)
    words = ["".join(rnd.choice("aeinorst") for _ in range(rnd.randint(8, 11))) for _ in range(300)]
    rows = []
    for i in range(600):
        base = [(0, 5, 30)] if i % 3 else []
        runs = [(40 + 20 * k, 40 + 20 * k + len(w), w) for k, w in enumerate(rnd.choices(words, k=500))]
        if i % 50 == 7:
            runs[3] = (100, 112, "longerword12")
            runs[9] = (220, 248, "a.thirteenchars.fourteenchars")
            runs += [(0, 3, "ab."), (1, 15, "fourteenchars.")]
        rows.append({"doc_id": {"_k1": i, "_k2": -i}, "base": base, "candidates": runs if i % 100 else []})
    table = pa.Table.from_pylist(rows, SLIM)
    batch = table.combine_chunks().to_batches()[0].slice(5)  # a batch need not start at the first row of its buffers
    del rows
    tracemalloc.start()
    out = [b for b in secrets.judged(iter([batch, batch.slice(0, 0)]), [Long()])]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 12_000_000, peak
    got = {r["doc_id"]["_k1"]: [tuple(s.values()) for s in r["spans"]] for b in out for r in b.to_pylist()}
    assert sorted(got) == list(range(5, 600))
    for i, spans in got.items():
        want = [(0, 5, 30)] if i % 3 else []
        if i % 50 == 7:
            want += [(3, 100, 112), (3, 220, 249), (3, 1, 15)]
        assert spans == sorted(want, key=lambda x: (x[1], x[0])), i


def test_pieces_are_bounded_by_their_text(monkeypatch):
    assert list(secrets.pieces([], 10)) == []
    assert list(secrets.pieces([4, 4, 4, 30, 0, 1], 10)) == [(0, 2), (2, 3), (3, 4), (4, 6)]
    assert list(secrets.pieces([0, 0, 0], 10)) == [(0, 3)]


def test_no_format_and_odd_rows(spark):
    """Null texts and ids, repeated rows and texts without any run keep their rows."""
    rows = [(None, "password = abcdefgh12"), (1, None), (1, None), (2, ""), (2, "no runs")]
    got = secrets.digest(secrets.find_secrets(documents(spark, rows))).collect()
    assert sorted((str(r.doc_id), r.spans) for r in got) == [("1", ""), ("1", ""), ("2", ""), ("2", ""), ("None", "assign:0:21")]
