"""Benchmark decontamination against plain searches: the index, recall near the threshold, short items, slices."""

import random
import re

import numpy as np
import pytest

from folioframe.llm import decontamination


def prose(rng, n):
    return " ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(n))


def items_and_docs():
    rng = random.Random(5)
    items = [(i, prose(rng, 20 + i)) for i in range(12)] + [(50, None), (51, "Too SHORT"), (52, ""), (53, "six words make this an item"), (2, "twice the same id, also one of eight words")]
    near = items[3][1].split()
    near[0] = "changed"
    rows = [(1, prose(rng, 30) + " " + items[2][1].upper() + ". " + prose(rng, 9)), (2, prose(rng, 200)), (3, None), (4, ""), (5, prose(rng, 5) + " " + " ".join(near))]
    rows += [(6, items[11][1]), (7, "far too short"), (8, "a too-short text, but six words make this an item."), (9, "six words make this an"), (10, "too"), (None, "short"), (3, None), (6, items[11][1])]
    return items, rows


@pytest.mark.parametrize("slice_items", [4096, 4])
def test_leaks(spark, slice_items):
    items, rows = items_and_docs()
    docs = spark.createDataFrame([(*r, "x", 1, 2, 3) for r in rows], "doc_id long, text string, leaks string, _h int, _row int, _k int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = {1: [2], 2: [], 3: [], 4: [], 5: [3], 6: [11], 7: [51], 8: [51, 53], 9: [], 10: [], None: []}
    got = [(r["doc_id"], [x["item"] for x in r["leaks"]]) for r in decontamination.find_leaks(docs, bench, slice_items=slice_items).collect()]
    assert len(got) == len(rows) and dict(got) == want and all(want[d] == x for d, x in got)
    left = decontamination.drop_leaks(docs, bench, slice_items=slice_items)
    assert left.columns == docs.columns
    assert sorted((r["doc_id"] or 0 for r in left.collect())) == sorted(d or 0 for d, _ in rows if not want[d])
    assert decontamination.drop_leaks(docs, bench.limit(0)).count() == len(rows)
    assert decontamination.find_leaks(docs.limit(0), bench).count() == 0


def plain(text, items):
    """Items of which a window as long as they are reaches the threshold, by all windows of the text."""
    cut = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    sets = {i: [tuple(w[k : k + 5]) for k in range(len(w) - 4)] for i, t in items for w in [cut(t)]}
    holders = {}
    for s in sets.values():
        for x in set(s):
            holders[x] = holders.get(x, 0) + 1
    w, out = cut(text), []
    every = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
    for i, s in sets.items():
        weigh = lambda x, own=set(s): 1 / (1 + np.log(holders[x])) if x in own else 1.0
        best = 0.0
        for p in range(max(1, len(every) - len(s) + 1)):
            v = every[p : p + len(s)]
            both = set(v) | set(s)
            best = max(best, sum(weigh(x) * min(v.count(x), s.count(x)) for x in both) / sum(weigh(x) * max(v.count(x), s.count(x)) for x in both))
        if best >= 0.8:
            out.append(i)
    return out


def test_recall_near_the_threshold(spark):
    """Passages with a few changed words, at all similarities around 0.8: what a search of all windows finds is found."""
    rng = random.Random(9)
    template = prose(rng, 6)
    items = [(i, (template + " " if i % 3 == 0 else "") + prose(rng, rng.randint(14, 59))) for i in range(30)]
    texts = []
    for k in range(300):
        w = items[k % 30][1].split()
        for at in rng.sample(range(len(w)), rng.randint(0, 3)):
            w[at] = prose(rng, 1)
        texts.append(prose(rng, rng.randint(0, 20)) + " " + " ".join(w) + " " + prose(rng, rng.randint(0, 20)))
    docs, bench = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {r["doc_id"]: [x["item"] for x in r["leaks"]] for r in decontamination.find_leaks(docs, bench).collect()}
    want = {i: plain(t, items) for i, t in enumerate(texts)}
    found = sum(len(set(got[i]) & set(want[i])) for i in want)
    assert all(set(got[i]) <= set(want[i]) for i in want)
    assert found >= 0.95 * sum(map(len, want.values())) > 80


def test_index_guarantee():
    """All fingerprints within the radius are candidates, and few of the others are looked at."""
    rng = random.Random(2)
    names = [np.array([rng.getrandbits(64) for _ in range(20)], np.uint64) for _ in range(400)]
    index = decontamination.Index([(i, x, np.ones(16, np.int32)) for i, x in enumerate(names)])
    prints = index.prints.copy()
    for i in range(len(prints)):
        for bit in rng.sample(range(64), rng.randint(0, decontamination.RADIUS)):
            prints[i] ^= np.uint64(1 << bit)
    far = np.bitwise_count(prints[:, None] ^ index.prints[None, :])
    want = set(zip(*(x.tolist() for x in np.nonzero(far <= decontamination.RADIUS)), strict=True))
    row, item = index.candidates(prints)
    assert set(zip(row.tolist(), item.tolist(), strict=True)) == want >= {(i, i) for i in range(400)}
    random_prints = np.array([rng.getrandbits(64) for _ in range(500)], np.uint64)
    assert len(index.fetched(random_prints)[0]) < 0.06 * 500 * 400
