"""Spelling variants against a plain version."""

import random
import re
import zlib
from collections import Counter

import numpy as np

from gleanframe.llm import spelling as module
from gleanframe.llm.spelling import Cell, grow, letter_counts, letters, one_edit, search, spelling_variants


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:k] + long[k + 1 :] == short for k in range(len(long)))


def plain(rows, length, count, times, noise):
    n = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", "".join(c.lower() if c < "\x80" else c for c in text or "")):
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if noise and h % noise == 0 else run] += 1
    n = {w: k for w, k in n.items() if len(w) >= length and k >= count}
    forms, close = {}, {}
    for w in n:
        close[w] = [x for x in n if near(w, x)]
        best = min(close[w], key=lambda x: (-n[x], x), default=None)
        forms[w] = best if best and n[best] >= times * n[w] else None
    out = []
    for w in n:
        root = w
        while forms[root]:
            root = forms[root]
        out.append((w, forms[w], root, n[w], len(close[w]), n[forms[w]] if forms[w] else None))
    return sorted(out)


def vocabulary(rng, n, sizes, alphabet):
    out = {"".join(rng.choice(alphabet) for _ in range(rng.choice(sizes))) for _ in range(n)}
    for w in list(out)[: n // 2]:
        k = rng.randrange(len(w))
        out |= {w[:k] + w[k + 1 :], w[:k] + rng.choice(alphabet) + w[k:], w[:k] + rng.choice(alphabet) + w[k + 1 :]}
    return sorted(out)


def test_every_pair_is_found():
    rng = random.Random(2)
    for alphabet, sizes, leaf in (("abcdeé÷ÿ", [5, 6, 7], 8), ("ab", [9, 10], 4), ("abc", [6], 1)):
        words = vocabulary(rng, 500, sizes, alphabet)
        by = {s: [w for w in words if len(w) == s] for s in {len(w) for w in words}}
        module.LEAF, held = leaf, module.LEAF
        try:
            for s, own in by.items():
                cell = Cell(own, np.ones(len(own), dtype=np.int64))
                for t in (s - 1, s, s + 1):
                    asked = by.get(t, [])
                    if asked:
                        a, b = cell.near(asked)
                        got = sorted((asked[i], cell.words[j]) for i, j in zip(a, b))
                        assert got == sorted((x, y) for x in asked for y in own if near(x, y))
        finally:
            module.LEAF = held


def test_boxes_prune_nothing_within_reach():
    rng = np.random.default_rng(3)
    counts = rng.integers(0, 3, (400, module.DIMENSIONS)).astype(np.int8)
    tree = grow(counts, 10)
    assert sorted(np.concatenate(tree.members).tolist()) == list(range(400))
    for more, less in ((0, 0), (1, 0), (0, 1), (1, 1)):
        reached = {(int(r), int(m)) for leaf, rows in search(tree, counts, more, less) for r in rows for m in tree.members[leaf]}
        step = counts[None].astype(int) - counts[:, None]
        fits = (np.maximum(step, 0).sum(2) <= more) & (np.maximum(-step, 0).sum(2) <= less)
        assert {(int(a), int(b)) for a, b in zip(*np.nonzero(fits))} <= reached
    assert sum(len(rows) for _, rows in search(tree, counts, 0, 0)) == 400
    long = letters(["a" * 500 + "b", "a" * 501])
    assert letter_counts(long).max() == module.MOST and one_edit(long[:1], long[1:]).tolist() == [True]


def test_spelling_variants(spark, monkeypatch):
    rng = random.Random(5)
    words = vocabulary(rng, 150, [4, 5, 6], "abcé") + ["Ünder", "ünder", "UNDER", "x×y÷z"]
    weights = [1 / (1 + k % 40) ** 1.5 for k in range(len(words))]
    rows = [(i, " ".join(rng.choices(words, weights, k=150)) + rng.choice([".", "\n", "1", "日"])) for i in range(120)]
    rows += [(900, None), (901, ""), (None, " ".join(words)), (5, rows[5][1]), (5, rows[5][1]), (902, "abcab-" * 220_000 + "b" * 2000)]
    df = spark.createDataFrame([(i, t, "w", 3) for i, t in rows], "doc_id long, text string, word string, n int").repartition(5)
    columns = ["word", "form", "root", "n", "n_near", "form_n"]
    for length, count, times, noise, cell, leaf, sample in ((4, 5, 5, 7, 4096, 48, 1000), (3, 2, 2, None, 8, 4, 1000), (4, 1, 3, 3, 8, 2, 40)):
        for name, value in (("CELL", cell), ("LEAF", leaf), ("SAMPLE", sample), ("HELD", 50)):
            monkeypatch.setattr(module, name, value)
        got = spelling_variants(df, least_length=length, least_count=count, times=times, noise=noise).select(*columns).collect()
        assert sorted((tuple(r) for r in got), key=lambda r: r[0]) == plain(rows, length, count, times, noise)
    assert any(r["root"] != r["form"] for r in got if r["form"])
    assert spelling_variants(df.limit(0)).collect() == []
