"""Importance resampling against a plain version."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np

from gleanframe.llm import resample as module
from gleanframe.llm.resample import crcs, resample

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain(rows, target, percent, runs, buckets, least, seed=2024):
    """(id, n_features, weight, score, rank) of every row; ids are distinct."""
    def spread(text):
        words = WORD.findall((text or "").encode().translate(bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))))
        return len(words), [zlib.crc32(b" ".join(words[i : i + k])) % buckets for k in range(1, runs + 1) for i in range(len(words) - k + 1)]

    own = [(i, *spread(t)) for i, t in rows]
    s, t = Counter(b for _, _, f in own for b in f), Counter(b for x in target for b in spread(x)[1])
    gain = {b: math.floor(1000 * math.log(float(t[b] + 1) * float(s.total() + buckets) / (float(s[b] + 1) * float(t.total() + buckets)))) for b in s}
    out = []
    for i, n, f in own:
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        out.append([i, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296.0)))])
    fit = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is not None, r[0] or 0))
    rank = {r[0]: k + 1 for k, r in enumerate(fit[: percent * len(fit) // 100])}
    return sorted(((i, f, w, sc, rank.get(i)) for i, _, f, w, sc in out), key=repr)


def texts(rng, n):
    pool = ["a", "B", "ab", "é", "ÀÖ", "word", "WORD", "0", "日本", "x" * 300, "longer-words", "'s"] + ["w%d" % k for k in range(50)]
    return [" ".join(rng.choice(pool) for _ in range(rng.randint(0, 60))) for _ in range(n)]


def test_crcs_equal_the_library():
    rng = np.random.default_rng(1)
    sizes = rng.integers(0, 300, 500)
    starts = rng.integers(0, 1000, 500)
    data = rng.integers(0, 4, 1300).astype(np.uint8)
    want = [zlib.crc32(data[a : a + n].tobytes()) for a, n in zip(starts, sizes)]
    exact = np.array([hash(data[a : a + n].tobytes()) for a, n in zip(starts, sizes)]).astype(np.uint64)
    assert crcs(data, starts, sizes, exact).tolist() == want
    assert crcs(data, starts, sizes, np.zeros(500, dtype=np.uint64)).tolist() == want  # one mark for all: told apart by bytes


def test_resample(spark, monkeypatch):
    rng = random.Random(4)
    rows = list(enumerate(texts(rng, 300)))
    rows += [(1000, None), (1001, ""), (1002, "... !!"), (None, "no id " * 12), (1003, rows[5][1]), (1004, "Ab w1 " * 250_000)]
    target = texts(rng, 20)[:15] + [None, ""]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, score int, id string").repartition(3)
    goal = spark.createDataFrame([(t, 5) for t in target], "text string, doc_id int")
    columns = ["doc_id", "n_features", "weight", "score", "rank"]
    for percent, runs, buckets, least in ((10, 1, 10_000, 20), (50, 2, 97, 1), (100, 3, 10, 0), (0, 1, 50, 5)):
        monkeypatch.setattr(module, "STEP", 1 << 18 if runs != 2 else 7000)
        got = resample(df, goal, percent, runs, buckets, least).select(*columns).collect()
        assert sorted((tuple(r) for r in got), key=repr) == plain(rows, target, percent, runs, buckets, least)


def test_repeated_rows_and_empty_tables(spark):
    rows = [(i % 7, "same words here") for i in range(70)] + [(i % 7, "other words") for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id int, text string")
    got = resample(df, df.limit(0), percent=50, least_words=1).collect()
    assert sorted(r["rank"] for r in got if r["rank"]) == list(range(1, 51)) and len(got) == 100
    drawn = [r["score"] for r in sorted((r for r in got if r["rank"]), key=lambda r: r["rank"])]
    assert drawn == sorted(drawn, reverse=True) and drawn[-1] >= max(r["score"] for r in got if not r["rank"])
    assert resample(df.limit(0), df).collect() == []
    assert len(resample(spark.createDataFrame([(1, "all")], "doc_id int, text string"), df).collect()) == 1


def test_slices_are_no_tree_of_comparisons(spark):
    """Half a thousand bounds as nested conditions make a generated method that takes hundreds of megabytes to compile."""
    rng = random.Random(8)
    df = spark.createDataFrame(list(enumerate(texts(rng, 400))), "doc_id long, text string")
    out = resample(df, df.limit(20), percent=50, least_words=1)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("CASE WHEN") < 20
