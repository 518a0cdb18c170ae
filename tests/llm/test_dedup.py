"""Exact, near and suffix duplicates, components, benchmark windows: against brute force on small tables."""

import hashlib
import random
import re
from collections import Counter
from itertools import combinations

import numpy as np
import pytest

from gleanframe.llm import induced_sort, suffix_dedup
from gleanframe.llm.common import components
from gleanframe.llm.decontaminate import contamination
from gleanframe.llm.exact_dedup import MisraGries, exact_duplicates
from gleanframe.llm.near_dedup import bag_min_hash, near_duplicates
from gleanframe.llm.suffix_dedup import remove_repeats

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ODD = "doc_id long, text string, digest string, row string, key long, node long"


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def table(spark, rows):
    """Ids and texts, with columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, "d", "r", 1, 2) for i, t in rows], ODD).repartition(3)


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n))


def sentences(seed=3):
    rng = random.Random(seed)
    base = [prose(rng, 60) for _ in range(12)]
    rows = [(i, t) for i, t in enumerate(base)]
    for i in range(12, 40):
        own = base[i % 5].split()
        for _ in range(i % 4):
            own[rng.randrange(len(own))] = prose(rng, 1)
        rows.append((i, " ".join(own)))
    rows += [(100, None), (101, ""), (102, "!!"), (103, "one two"), (104, "One two"), (105, "one two"), (106, base[0]), (107, base[0] + "!"),
             (108, "x y " * 4000), (109, "x y " * 4001), (None, base[1]), (None, "only this one has no id"), (7, base[7])]
    return rows


def test_misra_gries_keeps_what_is_frequent():
    rng = random.Random(1)
    keys = [rng.choice("ab") if rng.random() < 0.5 else str(rng.random()) for _ in range(3000)]
    summary = MisraGries(10)
    for at in range(0, 3000, 100):
        summary.update(Counter(keys[at : at + 100]))
    true = Counter(keys)
    assert len(summary.counts) <= 10 and {"a", "b"} <= set(summary.counts)
    assert all(true[k] - 3000 / 11 <= n <= true[k] for k, n in summary.counts.items())


@pytest.mark.parametrize("k", [1, 1000])
def test_exact_duplicates(spark, k):
    rows = sentences()
    got = sorted((tuple(r) for r in exact_duplicates(table(spark, rows), k=k).collect()), key=repr)
    copies = {}
    for i, t in rows:
        copies.setdefault(t or "", []).append(i)
    keep = {t: max((i for i in own if i is not None), default=None) for t, own in copies.items()}
    assert len(got) == len(rows)
    assert Counter(g[:3] + (g[4],) for g in got) == Counter(
        (i, keep[t or ""], len(copies[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows)
    kept = [g for g in got if g[3]]
    assert len(kept) == len(copies) and all(g[0] == g[1] for g in kept)
    assert exact_duplicates(table(spark, []).limit(0)).count() == 0


def test_components(spark):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(60)] + [(100, j) for j in range(101, 140)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(45)]
    edges += [(300, 300), (None, 1)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {x: x for e in edges if None not in e for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None:
            parent[find(a)] = find(b)
    assert got.keys() == parent.keys()
    assert all((got[a] == got[b]) == (find(a) == find(b)) for a, b in combinations(parent, 2))


def test_components_come_as_one_table(spark):
    """A caller that reads them several times plans no join of a round again."""
    rng = random.Random(6)
    edges = [(rng.randrange(90), rng.randrange(90)) for _ in range(60)] + [(i, i + 1) for i in range(200, 260)]
    plan = components(spark.createDataFrame(edges, "a long, b long"))._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan


def test_bag_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(2)
    one, two = rng.integers(0, 30, 300).astype(np.uint64), rng.integers(0, 30, 300)
    element = np.unique(one)
    a, b = rng.integers(1, 40, len(element)), rng.integers(1, 40, len(element))
    assert len(two)
    m = 4096
    s = bag_min_hash(np.repeat([0, 1], len(element)), np.tile(element, 2), np.concatenate([a, b]), 2, m)
    true = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    assert abs((s[0] == s[1]).mean() - true) < 5 * np.sqrt(true * (1 - true) / m)


def test_near_duplicates(spark):
    rows = sentences()
    got = near_duplicates(table(spark, rows)).collect()
    texts = sorted({t or "" for _, t in rows})
    bags = {}
    for t in texts:
        w = words(t)
        bags[t] = Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else Counter()
    group = {t: t for t in texts}
    for a, b in combinations(texts, 2):
        if (bags[a] & bags[b]).total() >= 0.8 * (bags[a] | bags[b]).total() > 0:
            old, new = group[a], group[b]
            group = {t: new if g == old else g for t, g in group.items()}
    members = {}
    for i, t in rows:
        members.setdefault(group[t or ""], []).append(i)
    smallest = {g: min((i for i in own if i is not None), default=None) for g, own in members.items()}
    assert Counter((r["doc_id"], r["class_id"], r["class_size"]) for r in got) == Counter(
        (i, smallest[group[t or ""]], len(members[group[t or ""]])) for i, t in rows)
    assert sum(r["kept"] for r in got) == len(members) and any(len(own) > 4 for own in members.values())
    assert near_duplicates(table(spark, []).limit(0)).count() == 0


@pytest.mark.parametrize("memory", [3, 1 << 22])
def test_suffix_order_and_common_prefixes(memory, monkeypatch):
    monkeypatch.setattr(induced_sort, "IN_MEMORY", memory)
    rng = random.Random(memory)
    for _ in range(60):
        alphabet = rng.choice([b"a", b"ab", b"abcd", bytes(range(256))])
        strings = [bytes(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(rng.randint(1, 5))]
        strings += strings[:2]
        shard, order, lcp = induced_sort.suffix_order(strings, 1000)
        text = tuple(shard.text.tolist())
        want = sorted(range(len(text)), key=lambda i: text[i:])
        assert order.tolist() == want
        for a, b, n in zip(want, want[1:], lcp[1:].tolist()):
            assert text[a : a + n] == text[b : b + n] and text[a + n : a + n + 1] != text[b + n : b + n + 1]


def test_remove_repeats(spark):
    rows = [r for r in sentences() if r[0] is not None and r[0] not in (108, 109)][:-1]
    rows += [(200, "ab" * 300), (201, "é" * 120), (202, rows[3][1][50:260]), (203, rows[4][1] + rows[4][1])]
    got = {r["doc_id"]: tuple(r)[1:] for r in remove_repeats(table(spark, rows)).collect()}
    seen = set()
    for i, t in sorted(rows):
        data = (t or "").encode()
        gone = bytearray(len(data))
        for s in range(len(data) - 99):
            if data[s : s + 100] in seen:
                gone[s : s + 100] = b"\1" * 100
            seen.add(data[s : s + 100])
        kept = bytes(b for b, g in zip(data, gone) if not g)
        assert got[i] == (len(data), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()), i


def test_remove_repeats_of_repeated_and_null_ids(spark):
    text = prose(random.Random(4), 40)
    rows = [(None, text), (1, text), (1, text), (1, "short")]
    got = Counter(tuple(r)[:3] for r in remove_repeats(table(spark, rows)).collect())
    n = len(text)
    assert got == Counter([(None, n, 0), (1, n, n), (1, n, n), (1, 5, 0)])
    assert remove_repeats(table(spark, []).limit(0)).count() == 0


def removed(rows):
    """Bytes and runs that go from each document, by the definition."""
    seen, out = set(), {}
    for i, t in sorted(rows):
        data = t.encode()
        gone = bytearray(len(data))
        for s in range(len(data) - 99):
            if data[s : s + 100] in seen:
                gone[s : s + 100] = b"\1" * 100
            seen.add(data[s : s + 100])
        out[i] = (len(data), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(bytes(b for b, g in zip(data, gone) if not g)).hexdigest())
    return out


def test_a_hot_key_is_dealt_over_tasks(spark, monkeypatch):
    """A passage between differing neighbours: at its edges two keys have a content for every document. None of them may reach a shard whole."""
    rng = random.Random(14)
    passage = prose(rng, 40)
    rows = [(i, prose(rng, 30) + "abc"[i % 3] + " " + passage + " " + "de"[i % 2] + prose(rng, 30)) for i in range(80)]
    held, dealt = suffix_dedup._sorted_shards, []

    def counted(contents, length):
        dealt.append(max((r["count"] for r in contents.groupBy("key").count().collect()), default=0))
        return held(contents, length)

    monkeypatch.setattr(suffix_dedup, "HOT", 20, raising=False)
    monkeypatch.setattr(suffix_dedup, "_sorted_shards", counted)
    got = {r["doc_id"]: tuple(r)[1:] for r in remove_repeats(table(spark, rows)).collect()}
    assert got == removed(rows)
    assert dealt and max(dealt) <= 20


def test_contents_are_told_apart_by_more_than_32_bits(spark):
    """Two texts of one window and one seed key, whose contents share 32 bits of their hash, are no copies."""
    tail = prose(random.Random(15), 30).encode()[:92]
    left = np.random.default_rng(5).integers(97, 123, (600_000, 8), dtype=np.uint8)
    up = suffix_dedup.powers(101)[0]
    hashes = (suffix_dedup._value[left] * up[:8]).sum(axis=1, dtype=np.uint64) + (suffix_dedup._value[np.frombuffer(tail, np.uint8)] * up[8:100]).sum(dtype=np.uint64)
    low = suffix_dedup.mix(hashes) & np.uint64(0xFFFFFFFF)
    order = np.argsort(low)
    keys = lambda t: suffix_dedup._segments(np.frombuffer(t + b"\0", np.uint8), np.array([0, 101]), 100)[2].tolist()
    pairs = [(left[order[k]].tobytes() + tail, left[order[k + 1]].tobytes() + tail) for k in np.flatnonzero(low[order[1:]] == low[order[:-1]])]
    a, b = next(p for p in pairs if p[0] != p[1] and keys(p[0]) == keys(p[1]))
    rows = [(1, a.decode()), (2, b.decode())]
    got = {r["doc_id"]: tuple(r)[1:] for r in remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == removed(rows) and got[2][1] == 0


def test_contamination(spark):
    docs = sentences()
    rng = random.Random(9)
    items = [(1, " ".join(docs[0][1].upper().split()[5:30])), (2, docs[1][1]), (3, "one TWO"), (4, None), (5, ""), (6, prose(rng, 30)), (2, docs[1][1]), (7, docs[0][1][40:90]),
             (8, "x y x y x y x y x y"), (None, docs[2][1])]
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, shingle int")
    got = Counter(tuple(r) for r in contamination(table(spark, docs), bench).collect())
    windows = {}
    for i, t in items:
        w = words(t)
        size = min(10, len(w))
        for p in range(len(w) - size + 1 if size else 0):
            windows.setdefault(tuple(w[p : p + size]), set()).add(i)
    want = Counter()
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for size in {len(x) for x in windows}:
            for p in range(len(w) - size + 1):
                if tuple(w[p : p + size]) in windows:
                    hit.update(range(p, p + size))
                    found |= windows[tuple(w[p : p + size])]
        names = sorted(str(x) for x in found if x is not None)
        want[(i, len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit))] += 1
    assert got == want
    none = contamination(table(spark, docs), bench.limit(0)).collect()
    assert len(none) == len(docs) and not any(r["contaminated"] for r in none)
    assert contamination(table(spark, []).limit(0), bench).count() == 0


def test_remove_repeats_of_a_text_of_over_a_mebibyte(spark):
    rng = random.Random(21)
    long = prose(rng, 210_000)
    rows = [(1, "abc" * 400), (2, long), (3, long[700_000:700_150] + "." + long[1_048_500:1_048_700]), (4, "cab" * 300 + long[:99]), (5, "cab" * 300)]
    assert len(long) > 1 << 20
    got = {r["doc_id"]: tuple(r)[1:] for r in remove_repeats(table(spark, rows)).collect()}
    assert got == removed(rows)


def test_segment_keys_spread_over_all_ranges_of_a_filter():
    """Keys are least hashes; as they were, nearly all lay in the lowest eighth, so a filter by ranges let through what occurs once."""
    data = np.random.default_rng(5).integers(97, 123, 60_000, dtype=np.uint8).tobytes()
    key = np.concatenate([part[3] for part in suffix_dedup.segments([data, data[:30_000]], 100)])
    assert np.all(np.histogram((key >> np.uint64(54)).astype(np.int64), 8, (0, 1 << 10))[0] > len(key) / 16)
