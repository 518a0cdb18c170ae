from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import PROBE_NAMES
from gleanframe.functions.text import clean_name, jaro_batch
from gleanframe.operators import names
from gleanframe.operators.names import similar_names, similar_strings


def jaro(a, b):
    """The textbook definition, one pair at a time."""
    if a == b:
        return 1.0
    window = max(max(len(a), len(b)) // 2 - 1, 0)
    ua, ub = [False] * len(a), [False] * len(b)
    for i, c in enumerate(a):
        for j in range(max(0, i - window), min(len(b), i + window + 1)):
            if not ub[j] and b[j] == c:
                ua[i] = ub[j] = True
                break
    ma = [c for c, u in zip(a, ua) if u]
    mb = [c for c, u in zip(b, ub) if u]
    if not ma:
        return 0.0
    t = sum(x != y for x, y in zip(ma, mb)) // 2
    m = len(ma)
    return (m / len(a) + m / len(b) + (m - t) / m) / 3


def test_jaro_batch():
    rng = np.random.default_rng(4)
    words = ["".join(rng.choice(list("abcde"), rng.integers(1, 14))) for _ in range(120)] + ["ä€😀", "äb😀", "x"]
    pairs = list(combinations(words, 2))
    got = jaro_batch([a for a, _ in pairs], [b for _, b in pairs])
    assert np.allclose(got, [jaro(a, b) for a, b in pairs], atol=1e-12)
    assert jaro_batch(["", "", "a"], ["", "a", "a"]).tolist() == [1.0, 0.0, 1.0]
    assert abs(jaro("martha", "marhta") - 0.944444) < 1e-6


def test_probe_names(probe):
    got = [(r["f1"], r["f2"], round(r["value"], 6)) for r in similar_names(probe, columns=PROBE_NAMES).collect()]
    assert got == [("sonar_depth_mm", "sonar_depth_cm", 0.952381)]


def test_brackets_do_not_count(spark):
    df = spark.createDataFrame([(1,) * 6], "`x (mg)` int, `x (ml)` int, `(only)` int, customer_id int, customer_idx int, `a,b` int")
    got = [(r["f1"], r["f2"], round(r["value"], 6)) for r in similar_names(df).collect()]
    assert got == [("x (ml)", "x (mg)", 1.0), ("customer_idx", "customer_id", 0.972222)]
    cleaned = df.sparkSession.createDataFrame([("a (b) (c) ",), ("plain",)], "n string").select(clean_name("n")).collect()
    assert [r[0] for r in cleaned] == ["a  ", "plain"]


def variants(rng, n, alphabet, longest):
    """Random words, with edited copies so that many pairs are similar."""
    words = set()
    while len(words) < n:
        w = list(rng.choice(list(alphabet), rng.integers(1, longest)))
        words.add("".join(w))
        for _ in range(2):
            v = w.copy()
            op = rng.integers(0, 3)
            at = int(rng.integers(0, len(v)))
            if op == 0:
                v[at] = str(rng.choice(list(alphabet)))
            elif op == 1 and len(v) > 1:
                v[at], v[at - 1] = v[at - 1], v[at]
            else:
                v.insert(at, str(rng.choice(list(alphabet))))
            words.add("".join(v))
    return sorted(words)


@pytest.mark.parametrize("tile,threshold,known", [(2000, 0.92, 1 << 16), (5, 0.92, 7), (50, 0.8, 1 << 16)])
def test_the_prefix_join_loses_no_pair(spark, monkeypatch, tile, threshold, known):
    monkeypatch.setattr(names, "TILE", tile)
    monkeypatch.setattr(names, "KNOWN_COUNTS", known)
    rng = np.random.default_rng(9)
    words = variants(rng, 150, "abcdefgh", 12) + variants(rng, 60, "0123456789-", 30) + variants(rng, 15, "abc d", 300)
    words += [f"Item#{i:05d}" for i in range(60)] + ["😀é" * 20, "😀é" * 19 + "😀"]
    words = sorted(set(words))
    df = spark.createDataFrame([(w,) for w in words], "w string")
    got = [(r["f2"], r["f1"]) for r in similar_strings(df, "w", threshold).collect()]
    want = {(a, b) for a, b in combinations(words, 2) if jaro(a, b) >= threshold}
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 100


def test_prefix_size():
    for threshold in (0.92, 0.85, 0.7, 0.5):
        for n in range(1, 400):
            partners = [(m, k) for k in range(1, 800) for m in [max(1, names.least_matches(n, k, threshold))] if m <= min(n, k)]
            assert names.prefix_size(n, threshold) >= n - min(m for m, _ in partners) + 1
    assert all(names.prefix_size(n, 0.92) <= 0.3 * n + 10 for n in range(1, 5000))


def test_long_strings(spark):
    rng = np.random.default_rng(2)
    base = "".join(rng.choice(list("abcdefgh "), 3000))
    df = spark.createDataFrame([(base,), (base[:-40],), (base[::-1],), (base[:1500] + "x" * 60 + base[1500:],)], "w string")
    got = {(r["f2"], r["f1"]) for r in similar_strings(df, "w").collect()}
    words = [r["w"] for r in df.collect()]
    assert got == {(min(a, b), max(a, b)) for a, b in combinations(words, 2) if jaro(a, b) >= 0.92} and got


def test_missing_and_repeated_values(spark):
    df = spark.createDataFrame([("customer_id",), ("customer_idx",), ("customer_id",), ("",), (None,), ("?",)], "w string")
    assert [(r["f1"], r["f2"]) for r in similar_strings(df, "w").collect()] == [("customer_idx", "customer_id")]
    assert similar_strings(df.filter(F.lit(False)), "w").count() == 0


@pytest.mark.parametrize("block,threshold,kinds", [(4096, 0.92, 1 << 10), (7, 0.92, 12), (20, 0.75, 1 << 10)])
def test_long_strings_are_compared_in_blocks_and_not_sent(spark, monkeypatch, block, threshold, kinds):
    """Every long line was sent once for each block of lines with the same element, which filled the disk."""
    sent, tiled = [], names.tiled
    monkeypatch.setattr(names, "tiled", lambda rows: sent.append(rows.agg(F.max("length")).first()[0]) or tiled(rows))
    monkeypatch.setattr(names, "BLOCK", block)
    monkeypatch.setattr(names, "KINDS", kinds)
    rng = np.random.default_rng(12)
    lines = variants(rng, 25, "etaoins rhl", 60) + variants(rng, 30, "etaoinshrdlu cmwf", 260) + variants(rng, 2, "ab c", 700) + ["ж" * 70, "ж" * 69 + "e", "e" * 66, "e" * 64]
    for line in [x for x in lines if len(x) > 64][::2]:
        moved = list(line)
        for at in rng.integers(0, len(moved), len(moved) // 6):
            moved[at], moved[at - 1] = moved[at - 1], moved[at]
        lines += ["".join(moved), line[len(line) // 5 :] + line[: len(line) // 5], line[: len(line) * 4 // 5]]
    lines = sorted(set(lines))
    want = {(a, b) for a, b in combinations(lines, 2) if min(len(a), len(b)) >= 0.2 * max(len(a), len(b)) and jaro(a, b) >= threshold}
    got = similar_strings(spark.createDataFrame([(x,) for x in lines], "w string"), "w", threshold).collect()
    assert {(r["f2"], r["f1"]) for r in got} == want and len(got) == len(want) and sum(len(a) > 64 for a, _ in want) > 50
    assert all(abs(r["value"] - jaro(r["f1"], r["f2"])) < 1e-12 for r in got)
    assert sent and max(sent) <= 64


def prose(rng, n, alphabet, longest):
    """Lines of words of common letters and a few rare ones, which are often absent from the beginning of another line."""
    common, rare = alphabet[:14], alphabet[14:]
    out = []
    for _ in range(n):
        letters = [str(rng.choice(list(rare))) if rng.random() < 0.05 else str(rng.choice(list(common))) for _ in range(rng.integers(longest * 9 // 10, longest))]
        for at in range(int(rng.integers(2, 7)), len(letters), 6):
            letters[at] = " "
        letters[3] = letters[len(letters) // 3] = "@"
        out.append("".join(letters))
    return out


def altered(rng, line):
    """The line with characters moved, also from the beginning to the end, and put in, in all about as much as leaves it similar."""
    out = list(line)
    for at in rng.integers(1, len(out), len(out) // 16):
        out[at], out[at - 1] = out[at - 1], out[at]
    out.insert(int(rng.integers(0, len(out))), "#")
    return "".join(c for c in out if c != "@") + "@" * out.count("@")


def out_of_order(a, b):
    """Matched characters that are not those that they are compared with, one by one."""
    window, ua, ub = max(len(a), len(b)) // 2 - 1, [False] * len(a), [False] * len(b)
    for i, c in enumerate(a):
        for j in range(max(0, i - window), min(len(b), i + window + 1)):
            if not ub[j] and b[j] == c:
                ua[i] = ub[j] = True
                break
    return sum(x != y for x, y in zip([c for c, u in zip(a, ua) if u], [c for c, u in zip(b, ub) if u]))


@pytest.mark.parametrize("longest", [90, 310])
def test_first_halves_tell_unlike_lines_apart(longest):
    """A tenth of the pairs of lines of 300 characters were compared whole: a head ended at the first character of which one was too far."""
    rng = np.random.default_rng(6)
    lines = prose(rng, 61, "etaoinshrdlucmwfgypbvkQXzjE", longest)
    lines += [altered(rng, x) for x in lines[:20]]
    (x,), (y,) = names.lines_of(lines[::2]), names.lines_of(lines[1::2])
    pairs = [(i, j) for i in range(len(x.strings)) for j in range(len(y.strings))]
    p, q = np.array([i for i, _ in pairs]), np.array([j for _, j in pairs])
    heads, whole = names.Heads(x, y), np.array([out_of_order(x.strings[i], y.strings[j]) for i, j in pairs])
    for size in (24, heads.size // 2 + 9, heads.size):
        assert (heads.differ(p, q, size) <= whole).all()
    assert (heads.differ(p, q, heads.size) >= 0.6 * heads.size).mean() > 0.9
    left = {(a, b) for one, two in names.alike(x, y, 0.92) for a, b in zip(one.tolist(), two.tolist())}
    similar = {(i, j) for i, j in pairs if jaro(x.strings[i], y.strings[j]) >= 0.92}
    assert similar and similar <= left and len(left) < len(similar) + 0.01 * len(pairs)
    got = {(r["a"], r["b"]) for one, two in names.alike(x, y, 0.92) for b in names.similar_rows(x, y, one, two, 0.92) for r in b.to_pylist()}
    assert got == {(x.strings[i], y.strings[j]) for i, j in similar}


def test_lines_of_other_characters_do_not_meet():
    """Blocks of two languages were compared pair by pair."""
    rng = np.random.default_rng(7)
    one, two = prose(rng, 50, "etaoinshrdlucmwfgypbvk", 300), prose(rng, 50, "éàuvqxjkwyzçèôîpbmnrts", 300)
    assert [len(v) for v in names.in_reach(*names.by_class(one)[:1], *names.by_class(two)[:1], names.by_class(one)[1], names.by_class(two)[1], 0.92)] == [0, 0]
    two += [altered(rng, one[3]), altered(rng, one[7])]
    (c, la), (d, lb) = names.by_class(one), names.by_class(two)
    rows, columns = names.in_reach(c, d, la, lb, 0.92)
    similar = [(i, j) for i, a in enumerate(one) for j, b in enumerate(two) if jaro(a, b) >= 0.92]
    assert similar and all(i in rows and j in columns for i, j in similar) and len(columns) < 25
