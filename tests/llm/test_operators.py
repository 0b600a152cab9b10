"""The dealt operators on awkward rows, against SQL or brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import xxhash

from seekwell.llm import decontamination, katz, packing_genetic, quality_classifier, quality_rules, secrets, simhash, substring_dedup, suffix_dedup
from seekwell.llm.tokens import vocabulary_path

from .fixtures import ITEMS, LONG, ROWS, benchmark, documents, prose, rows_of


@pytest.fixture(scope="module")
def con():
    db = duckdb.connect()
    db.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    db.executemany("INSERT INTO documents VALUES (?, ?)", ROWS)
    db.execute("CREATE TABLE benchmark (item_id BIGINT, text VARCHAR)")
    db.executemany("INSERT INTO benchmark VALUES (?, ?)", ITEMS)
    return db


def sql_rows(con, sql, names):
    cur = con.execute(sql)
    have = [d[0] for d in cur.description]
    return sorted((tuple(r[have.index(n)] for n in names) for r in cur.fetchall()), key=repr)


def test_decontamination(spark, con):
    out = decontamination.contamination(documents(spark), benchmark(spark)).drop("hit_words", "items")
    got = rows_of(out)
    # items without an id mark words but are not listed; SQL lists them as nothing too
    want = sql_rows(con, decontamination.sql(), out.columns)
    fix = lambda rows: [r[:out.columns.index("n_items")] + r[out.columns.index("items_sha256"):] for r in rows]
    assert fix(got) == fix(want)
    hit = {r[0] for r in got if r[-1]}
    assert {2, 3, 9, None, 15} <= hit and not hit & {1, 6, 7, 8, 10}
    kept = decontamination.without_documents(documents(spark), benchmark(spark))
    assert kept.columns == documents(spark).columns and rows_of(kept, "doc_id") == sorted(((d,) for d, t in ROWS if d not in hit), key=repr)
    one = documents(spark, [(3, "Alpha, " + ITEMS[0][1] + "! omega")])
    assert decontamination.without_spans(one, decontamination.contamination(one, benchmark(spark))).first()["text"].split() == ["Alpha,", "!", "omega"]


def test_decontamination_beyond_the_broadcast(spark, con):
    """The same rows when the windows are joined by hash, and no exchange carries the words of a text."""
    out = decontamination.contamination(documents(spark), benchmark(spark), limit=-1)
    assert rows_of(out) == rows_of(decontamination.contamination(documents(spark), benchmark(spark)))
    near = decontamination.contamination(documents(spark), benchmark(spark), limit=100)  # table too large, agreed places too
    assert rows_of(near) == rows_of(out)
    empty = decontamination.contamination(documents(spark), benchmark(spark).limit(0), limit=-1)
    assert {r.contaminated for r in empty.collect()} == {False} and empty.count() == len(ROWS)
    seen = []
    write = decontamination.cut

    def watched(df, name="cut"):
        seen.append((name, df._jdf.queryExecution().executedPlan().toString()))
        return write(df, name)

    decontamination.cut = watched
    try:
        decontamination.contamination(documents(spark), benchmark(spark), limit=-1)
    finally:
        decontamination.cut = write
    plan = dict(seen)["agreed"]
    for line in plan.splitlines():
        if "Exchange hashpartitioning" in line:
            assert "_words" not in line
    assert "SortMergeJoin" in plan or "ShuffledHashJoin" in plan or "BroadcastHashJoin" in plan


def test_quality_rules(spark, con):
    out = quality_rules.quality_rules(documents(spark))
    assert rows_of(out) == sql_rows(con, quality_rules.sql(), out.columns)
    kept = {r.doc_id: r.kept for r in out.collect()}
    assert kept[1] and kept[10] and not kept[6] and not kept[11] and not kept[13]
    overlapping = documents(spark, [(1, "a b c d e a b c d e a b c d e x y z")])
    assert quality_rules.measures(overlapping).first()["n_repeat_words"] == 15


@pytest.mark.parametrize("options", [{}, {"hot": 1, "sample": 1.0}, {"hot": 1, "sample": 1.0, "limit": 0}])
def test_substring_dedup(spark, con, options):
    out = substring_dedup.deduplicated(documents(spark), **options)
    assert rows_of(out) == sql_rows(con, substring_dedup.sql(), out.columns)
    assert {r.doc_id: r.n_removed for r in out.collect()}[4] == 150


def brute_bytes(rows, length):
    data = [(t or "").encode() for _, t in rows]
    count = Counter(d[i:i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for (doc_id, _), d in zip(rows, data):
        keep = np.ones(len(d), bool)
        for i in range(len(d) - length + 1):
            if count[d[i:i + length]] > 1:
                keep[i:i + length] = False
        spans = int((np.diff(np.concatenate([[0], (~keep).astype(int)])) == 1).sum())
        out.append((doc_id, len(d), int((~keep).sum()), spans, hashlib.sha256(bytes(np.frombuffer(d, np.uint8)[keep])).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("options", [{}, {"hot": 3}])
def test_suffix_dedup(spark, options):
    rows = [*ROWS, (30, "ab" * 400), (31, "xyz" + prose(1, 150)[37:700])]
    assert rows_of(suffix_dedup.deduplicated(documents(spark, rows), **options)) == brute_bytes(rows, 200)


def test_suffix_array_and_prefixes():
    rnd = random.Random(3)
    for _ in range(300):
        s = [rnd.randint(1, rnd.choice([1, 2, 4])) for _ in range(rnd.randint(0, 50))] + [0]
        assert suffix_dedup.sorted_places(np.array(s)).tolist() == sorted(range(len(s)), key=lambda i: s[i:])
    for _ in range(300):
        letters = rnd.choice([b"a", b"ab", b"abcd", bytes(range(256))])
        strings = [bytes(rnd.choice(letters) for _ in range(rnd.choice([0, 1, 3, 40]))) for _ in range(rnd.randint(1, 6))]
        shard = suffix_dedup.Shard(strings)
        s, order = shard.text.tolist(), shard.suffix_array()
        assert order.tolist() == sorted(range(len(s)), key=lambda i: s[i:])
        shared, previous = shard.shared(order)
        for a, b in zip(order.tolist(), order.tolist()[1:]):
            assert shared[b] == next(k for k in range(len(s)) if s[a + k] != s[b + k]) and previous[b] == a


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i:i + 4]).encode(), 42) for i in range(max(len(words) - 3, 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(ids, fps, bits=4):
    root = list(range(len(ids)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i in range(len(ids)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= bits:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [least.get(find(i)) for i in range(len(ids))]


def test_simhash(spark):
    fps = [brute_fingerprint(t) for _, t in ROWS]
    want = [(d, f"{f:016x}", c) for (d, _), f, c in zip(ROWS, fps, brute_components([d for d, _ in ROWS], fps))]
    out = simhash.near_groups(documents(spark))
    assert rows_of(out.select("doc_id", simhash.hex_fingerprint(out["fp"]), "component_id")) == sorted(want, key=repr)
    kept = simhash.one_of_each(documents(spark))
    assert kept.columns == documents(spark).columns and kept.count() == len({(c if c is not None else d) for d, _, c in want})


@pytest.mark.parametrize("hot", [simhash.HOT, 4])
def test_links_keep_components(spark, hot, monkeypatch):
    monkeypatch.setattr(simhash, "HOT", hot)
    rnd = random.Random(1)
    fps = {rnd.getrandbits(64) for _ in range(200)}
    for _ in range(600):  # chains and clusters
        x = rnd.choice(sorted(fps))
        for b in rnd.sample(range(64), rnd.randint(1, 5)):
            x ^= 1 << b
        fps.add(x)
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    from seekwell.llm.common import components

    df = spark.createDataFrame([(s,) for s in signed], "fp long")
    roots = {r.node: r.root for r in components(simhash.links(df)).collect()}
    got, want = defaultdict(set), defaultdict(set)
    for s in signed:
        got[roots.get(s, s)].add(s)
    for s, c in zip(signed, brute_components(list(range(len(fps))), fps)):
        want[c].add(s)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_packing(spark):
    from tokenizers import Tokenizer

    rows = packing_genetic.packed_pieces(documents(spark, [*ROWS, (40, "a <|endoftext|> b"), (41, LONG + " " + LONG)]), capacity=512).collect()
    tokenizer = Tokenizer.from_file(vocabulary_path())
    want = []
    for d, t in [*ROWS, (40, "a <|endoftext|> b"), (41, LONG + " " + LONG)]:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [0]
        want += [(d, k, s, min(512, len(ids) - s), zlib.crc32(np.array(ids[s:s + 512], "<u4").tobytes())) for k, s in enumerate(range(0, len(ids), 512))]
    assert sorted((tuple(r[:5]) for r in rows), key=repr) == sorted(want, key=repr)
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 512
    assert len(by) <= math.ceil(sum(r.length for r in rows) / 512) + 1


def test_packing_genetic_improves_on_best_fit():
    rnd = random.Random(5)
    sizes = [rnd.randint(200, 900) for _ in range(600)]
    bins = []
    packing_genetic.best_fit(sorted(range(600), key=lambda i: -sizes[i]), sizes, 1000, bins, [])
    best = packing_genetic.evolve(sizes, [], 1000, random.Random(1))
    assert sorted(i for b in best for i in b) == list(range(600)) and max(sum(sizes[i] for i in b) for b in best) <= 1000
    assert len(best) <= len(bins)


@pytest.mark.parametrize("options", [{}, {"batch_tokens": 300, "part_entries": 200, "hot": 20}])
def test_katz(spark, options):
    tokens = [(d, zlib.crc32(str("" if d is None else d).encode()) % 7 == 2, (t or "").encode().lower().split() + [b""]) for d, t in ROWS]
    one, two, n_docs = Counter(), Counter(), 0
    for _, held, ws in tokens:
        if not held:
            one.update(ws)
            two.update(zip([None, *ws], ws))
            n_docs += 1
    n, v = sum(one.values()), len(one)
    low = lambda c: [sum(x == r for x in c.values()) for r in range(1, 7)]
    words, d = katz.Words(n, v, n_docs, tuple(low(one))), katz.discounts(low(two))
    single = lambda w: float(words.probability(np.array([one[w]]))[0])
    assert sum(map(single, one)) + single(b"never seen") == pytest.approx(1, abs=1e-9)
    after = defaultdict(dict)
    for (h, w), c in two.items():
        after[h][w] = c
    left = {h: (1 - sum(d[min(c, 6)] * c for c in f.values()) / sum(f.values())) / (1 - sum(map(single, f))) for h, f in after.items()}
    want = []
    for doc_id, held, ws in tokens:
        score = 0.0
        for h, w in zip([None, *ws], ws):
            f = after.get(h)
            p = single(w) if not f else d[min(f[w], 6)] * f[w] / sum(f.values()) if w in f else left[h] * single(w)
            score += math.log10(p)
        want.append((doc_id, held, len(ws), sum(w in one for w in ws), n, sum(math.log10((one[w] + 1) / (n + v + 1)) for w in ws), score))
    got = katz.score(documents(spark), **options).collect()
    key = lambda r: (repr(r[0]), r[2], round(r[6], 6))
    for a, b in zip(sorted(map(tuple, got), key=key), sorted(want, key=key), strict=True):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], rel=1e-9)


def base_spans(text):
    text, found = text or "", []
    assign = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    for k, pattern, ok in (("assign", assign, lambda m: len(m[2]) >= 8), ("access", r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 16), ("hex", r"[0-9a-f]+", lambda m: len(m[0]) >= 32)):
        found += [(m.start(), ("assign", "access", "hex").index(k), f"{k}:{m.start()}:{m.end()}") for m in re.finditer(pattern, text) if ok(m)]
    return [s for _, _, s in sorted(found)]


def test_secrets(spark):
    rnd = random.Random(4)
    rows = list(ROWS)
    for i in range(120):
        key = "".join(rnd.choice("0123456789abcdef") for _ in range(40))
        rows.append((100 + i, f"é{prose(i, 12)} token = \"{key}\" {prose(i + 1, 5)}"))
    planted = "".join(rnd.choice("0123456789abcdef") for _ in range(26))
    rows.append((900, f"before {planted} after donaudampfschiffahrts12gesellschaft and 4111-1111-1111-1111 x"))
    got = {}
    for r in secrets.digest(secrets.find_secrets(documents(spark, rows))).collect():
        got.setdefault(r.doc_id, []).append(r)
    for d, t in rows:
        base = base_spans(t)
        sha = hashlib.sha256(",".join(base).encode()).hexdigest()
        r = next(x for x in got[d] if x.base_sha256 == sha)
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(x.startswith(k) for x in base) for k in ("assign", "access", "hex")]
        if d != 900:
            assert r.spans == ",".join(base)
    assert got[900][0].spans == f"format:7:{7 + len(planted)}"
    out = secrets.redacted(documents(spark, rows))
    clean = {d for d, t in rows if not base_spans(t) and d != 900}
    assert out.columns == documents(spark).columns
    texts = dict((d, t) for d, t in rows if d in clean)
    for r in out.collect():
        assert r.doc_id not in clean or r.text == texts[r.doc_id] or r.doc_id == 14
        assert r.n_chars == (None if r.text is None else len(r.text))
    assert out.filter("doc_id = 900").first()["text"].startswith("before [SECRET] after")


def test_classifier(spark):
    rows = [(i, prose(i, 80) if i % 3 else f"{'JUNK!! ' * (20 + i % 7)}") for i in range(300)] + [(None, None), (400, ""), (1, prose(1, 80))]
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(300)] + [(400, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    docs = documents(spark, rows)
    model = quality_classifier.train(docs, labels)
    out = quality_classifier.classify(docs, model)
    got = out.collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert all(r.held_out == (zlib.crc32(str("" if r.doc_id is None else r.doc_id).encode()) % 5 == 0) for r in got)
    wrong = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 300 and r.predicted != int(r.doc_id % 3 > 0)]
    assert not wrong
    kept = quality_classifier.accepted(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(r.predicted for r in got)
    # flat traversal equals walking each tree by hand
    x = np.array([quality_classifier.statistics(t) for _, t in rows[:50]])
    for row, score in zip(x, model.score(x)):
        total = model.start
        for f, b, leaf in zip(model.feature, model.border, model.leaf):
            node = 0
            while node < len(f):
                node = 2 * node + (2 if row[f[node]] > b[node] else 1)
            total += leaf[node - len(f)]
        assert score == pytest.approx(1 / (1 + math.exp(-total)))
    none = labels.filter("false")
    assert {r.score for r in quality_classifier.classify(docs, quality_classifier.train(docs, none)).collect()} == {0.5}


def test_empty_tables(spark):
    docs, items = documents(spark, []), benchmark(spark, [])
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for out in (
        decontamination.contamination(docs, items), decontamination.without_documents(docs, items), quality_rules.quality_rules(docs), substring_dedup.deduplicated(docs),
        suffix_dedup.deduplicated(docs), simhash.near_groups(docs), simhash.one_of_each(docs), packing_genetic.packed_pieces(docs), katz.score(docs),
        secrets.digest(secrets.find_secrets(docs)), secrets.redacted(docs), quality_classifier.classify(docs, quality_classifier.train(docs, labels)),
    ):
        assert out.collect() == []
    assert decontamination.contamination(documents(spark), items).filter("contaminated").count() == 0
