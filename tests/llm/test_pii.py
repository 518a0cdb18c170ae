"""Personal data against a plain version, and planted candidates."""

import hashlib
import random
import re

from gleanframe.llm.pii import FOR, SILENT, personal_data, posteriors

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def valid(kind, match):
    numbers = re.sub("[^0-9]", "", match)
    if kind == "ip":
        return all(int((x.lstrip("0") or "0")[:4]) <= 255 for x in match.split("."))
    if kind == "card":
        total = sum(d if k % 2 == 0 else d * 2 - 9 * (d > 4) for k, d in enumerate(map(int, reversed(numbers))))
        return 16 <= len(numbers) <= 19 and total % 10 == 0
    return kind == "email" or 8 <= len(numbers) <= 15


def plain(text):
    return [(k, m.start(), m.end()) for k, p in PATTERNS.items() for m in re.finditer(p, text or "") if valid(k, m.group())]


def check(rows, got):
    by = {r["doc_id"]: r for r in got}
    assert len(got) == len(rows)
    for key, text in rows:
        want = plain(text)
        listed = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        row = by[key]
        assert [row[f"n_{k}"] for k in PATTERNS] == [sum(w[0] == k for w in want) for k in PATTERNS], (key, text[:200])
        assert row["base_sha256"] == hashlib.sha256(listed.encode()).hexdigest()
        spans = row["spans"].split(",") if row["spans"] else []
        assert set(listed.split(",")) - {""} <= set(spans) and len(spans) == len(want) + row["n_added"]
        order = [(list(PATTERNS).index(s.split(":")[0]), int(s.split(":")[1])) for s in spans]
        assert order == sorted(order)


def test_random_texts(spark):
    rng = random.Random(3)
    parts = ["a@b.c", "@", ".", "x.y", "-", "+", "1", "12", "4111 1111 1111 1111", "4111-1111-1111-1112", " ", "é", "𝔘", "255", "256", "0007", ".1", "300.1.2.3",
             "+49 (30) 123-4567", "(", ")", "1.2.3.4", "\n", "%", "_", "cd%x@e.f", "4041894974608795", "at", " dot "]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randint(0, 40)))) for i in range(1500)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    check(rows, personal_data(df).collect())


def test_edges(spark):
    rows = [(1, None), (2, ""), (None, "a@b.co"), (3, "1.2.3.4 " * 1500), (4, "xyz " * 300_000 + " a@b.co " + ".1" * 2000),
            (5, "a" + ".a" * 30_000 + "@b" + ".c" * 30_000), (6, "0" * 20_000 + ".1.1.1 " + "+1" + "(" * 20_000), (7, "same@x.org"), (8, "same@x.org")]
    df = spark.createDataFrame([(i, t, "x", [1]) for i, t in rows], "doc_id long, text string, spans string, start array<int>")
    check(rows, personal_data(df).collect())
    # Runs without a match, over which the plain version takes quadratic time.
    long = personal_data(spark.createDataFrame([(1, "x" * 1_000_000 + " a@b.co " + ".1" * 50_000)], "doc_id long, text string")).first()
    assert (long["n_email"], long["n_ip"], long["spans"][:22]) == (1, 12_500, "email:1000001:1000007,")
    assert personal_data(df.limit(0)).collect() == []
    twice = personal_data(df.filter("doc_id = 7").unionByName(df.filter("doc_id = 7"))).collect()
    assert len(twice) == 2 and twice[0] == twice[1]


def test_added_spans(spark):
    rng = random.Random(9)
    rows, planted, decoys = [], {}, set()
    words = ["river", "stone", "house", "green", "walk", "paper", "light"]
    filler = lambda n: " ".join(rng.choice(words) for _ in range(n))
    for i in range(400):
        text = filler(12)
        if i % 4 == 0:
            text += rng.choice([" e-mail user.name@mail.example.com ", " phone +1 (555) 010-4477 ", " server 10.1.2.3 "])
        elif i % 4 == 1:
            text += " contact "
            found = f"jo{i}" + rng.choice([" [at] ", " (at) ", " at "]) + "mail" + rng.choice([" [dot] ", " dot "]) + "com"
            planted[i] = (len(text), len(text) + len(found), "email")
            text += found + " " + filler(3)
        elif i % 4 == 2:
            decoys.add(i)
            text += " version 1 . 20 . 3 . 999 and total 1200-3400-55 " + filler(3)
        rows.append((i, text))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = personal_data(df).collect()
    check(rows, got)
    by = {r["doc_id"]: r for r in got}
    for i, (start, end, kind) in planted.items():
        assert f"{kind}:{start}:{end}" in by[i]["spans"].split(","), rows[i]
    assert not any(by[i]["n_added"] for i in by if i not in planted)


def test_posteriors():
    # Two good labelers, one that tosses a coin, for 1000 spans.
    rng, counts, truths = random.Random(1), {}, {}
    for _ in range(1000):
        truth = rng.random() < 0.4
        vote = lambda right: (FOR if truth == (rng.random() < right) else 0)
        votes = (SILENT, vote(0.95), vote(0.9), vote(0.5), vote(0.9))
        code = sum(v * 3 ** (4 - j) for j, v in enumerate(votes))
        counts[0, code] = counts.get((0, code), 0) + 1
        truths.setdefault(code, []).append(truth)
    likely = posteriors(counts)
    right = sum(sum(t == (likely[0, c] > 0.5) for t in ts) for c, ts in truths.items())
    assert right > 940 and posteriors({}) == {}
