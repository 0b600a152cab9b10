"""Good-Turing discounts on rows with copies, written again without the module's helpers."""

import math
import random
import zlib
from collections import Counter, defaultdict

import pytest

from seekwell.llm import katz

from .fixtures import documents


def copied_rows():
    """Words with a long tail, and a part of the texts five times, so that five-fold counts lie above their trend."""
    rnd, rows = random.Random(11), []
    draw = lambda n: " ".join(f"w{int(rnd.paretovariate(0.7))}" for _ in range(n))
    for i in range(100):
        rows += [(len(rows) + k, text) for text in [draw(40)] for k in range(5 if i % 12 == 0 else 1)]
    return rows


def good_turing(counts):
    """Katz's factors for counts 1 to 5 with the line through log n_r over log r, and the raw ones."""
    have = Counter(counts)
    rs = [r for r in range(1, 7) if have[r]]
    points = []
    for i, r in enumerate(rs):
        q = rs[i - 1] if i else 0
        t = rs[i + 1] if i + 1 < len(rs) else 2 * r - q
        points.append((math.log(r), math.log(have[r] / (0.5 * (t - q)))))
    mx, my = (sum(p[k] for p in points) / len(points) for k in (0, 1))
    slope = sum((x - mx) * (y - my) for x, y in points) / sum((x - mx) ** 2 for x, _ in points)
    smooth = lambda r: math.exp(my + slope * (math.log(r) - mx))

    def katz_form(n):
        tail = 6 * n(6) / n(1)
        return [((r + 1) * n(r + 1) / n(r) / r - tail) / (1 - tail) for r in range(1, 6)]

    return katz_form(smooth), katz_form(lambda r: have[r])


def test_good_turing_on_copies(spark):
    rows = copied_rows()
    tokens = [(d, zlib.crc32(str(d).encode()) % 7 == 2, [*t.encode().split(), b""]) for d, t in rows]
    one, two, starts = Counter(), Counter(), 0
    for _, held, ws in tokens:
        if not held:
            one.update(ws)
            two.update(zip([None, *ws], ws))
            starts += 1
    tables = []
    for table in (one, two):
        smooth, raw = good_turing(table.values())
        assert any(not 0 < d < 1 for d in raw) and all(0 < d < 1 for d in smooth)
        have = Counter(table.values())
        assert katz.discounts([have[r] for r in range(1, 7)]).tolist() == pytest.approx([1, *smooth, 0.999])
        tables.append([1, *smooth, 0.999])
    total, (d1, d2) = sum(one.values()), tables
    keep = lambda d, c: d[min(c, 6)] * c
    freed = 1 - sum(keep(d1, c) for c in one.values()) / total
    single = lambda w: keep(d1, one[w]) / total if one[w] else freed
    after = defaultdict(dict)
    for (h, w), c in two.items():
        after[h][w] = c
    want = {}
    for doc_id, _, ws in tokens:
        score = 0.0
        for h, w in zip([None, *ws], ws):
            f = after.get(h, {})
            n = sum(f.values())
            if w in f:
                score += math.log10(keep(d2, f[w]) / n)
            else:
                left = (1 - sum(keep(d2, c) for c in f.values()) / n) / (1 - sum(map(single, f))) if f else 1
                score += math.log10(left * single(w))
        want[doc_id] = score
    got = {r.doc_id: r.score for r in katz.score(documents(spark, rows)).collect()}
    assert got == pytest.approx(want, rel=1e-9)


@pytest.mark.parametrize("low", [[0, 0, 0, 0, 0, 0], [9, 0, 3, 1, 0, 0], [0, 5, 1, 0, 0, 0], [5, 5, 5, 5, 5, 5], [100, 30, 0, 8, 9, 0], [16698, 3601, 1290, 594, 471, 213]])
def test_factors_lie_between_zero_and_one(low):
    d = katz.discounts(low)
    assert len(d) == 7 and (d[1:] > 0).all() and (d[1:] < 1).all()
