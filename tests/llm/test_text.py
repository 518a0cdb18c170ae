"""Tokens, languages, toxicity, quotations."""

import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import tiktoken
from pyspark.sql import functions as F

from gleanframe.llm import bpe
from gleanframe.llm.language import identify, learn
from gleanframe.llm.quotes import normalised, parse, reply_order
from gleanframe.llm.toxicity import PATTERNS, clause_features, compiled, lexicon, toxicity
from gleanframe.llm.words import word_groups

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def reference_encoding():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_pieces_don_t_change_the_tokens():
    enc, rng = reference_encoding(), random.Random(1)
    parts = ["don't", " they're", "  ", "\n\n", " 123", "4.5", "日本語、", "テスト。", "é", "!!'s", " <|endoftext|>", "\t", "x" * 30, "á", " "]
    for size in (1, 7, 40):
        for _ in range(60):
            text = "".join(rng.choice(parts) for _ in range(80))
            assert bpe.encode(enc, text, size).tolist() == enc.encode_ordinary(text)
            assert "".join(bpe.pieces(text, size)) == text


def test_encode_documents(spark):
    rows = [(1, "Hello wörld"), (1, "Hello wörld"), (2, None), (None, ""), (3, "word " * 60_000), (4, "e" * 3000)]
    df = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, n_tokens int")
    enc = reference_encoding()
    got = sorted((tuple(r) for r in bpe.encode_documents(df, RANKS, public_tokenizers.PATTERN, with_ids=True).collect()), key=repr)
    want = []
    for i, t in rows:
        ids = enc.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest(), ids))
    assert got == sorted(want, key=repr)
    assert bpe.encode_documents(df.limit(0), RANKS, public_tokenizers.PATTERN).count() == 0


def invented(rng, syllables, n):
    return " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(n))


def test_identify(spark):
    rng = random.Random(8)
    kinds = {"aa": ["ka", "to", "mi", "re"], "bb": ["sch", "ung", "der", "ein"], "cc": ["que", "eau", "ré", "oi"]}
    rows = [(i, invented(rng, kinds[k], rng.randint(8, 60)), k) for i, k in enumerate(sorted(kinds) * 40)]
    rows += [(900, None, "aa"), (901, "", "bb"), (902, "12 !?", "cc"), (903, "schungderein " * 20_000, None), (None, "quequeeau oioi réré", None), (3, rows[3][1], "bb")]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, lang string, lang_pred string, score int")
    got = identify(df).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    pred = {r["doc_id"]: r["lang_pred"] for r in got if r["doc_id"] != 3}
    assert pred[900] == pred[901] == pred[902] == "und" and pred[903] == "bb" and pred[None] == "cc"
    held = [r for r in got if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < 120]
    assert len(held) > 10 and all(r["lang_pred"] == sorted(kinds)[r["doc_id"] % 3] for r in held if r["doc_id"] != 3)
    assert identify(df.limit(0)).count() == 0
    unlabelled = identify(df.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r["lang_pred"] for r in unlabelled} == {"und"}


def test_copies_and_many_languages_leave_no_language_out(spark):
    rng = random.Random(9)
    own = [(f"{i:03d}", invented(rng, ["ka", "to", "mi", "re"], 20)) for i in range(130) for _ in range(3)]
    few = spark.createDataFrame([(i, t, k) for i, (k, t) in enumerate(own)] + [(9000 + i, invented(rng, ["que", "eau"], 20), "es") for i in range(5)],
                                "doc_id long, text string, lang string")
    copies = spark.range(10_000, 150_000, 1, 4).select(F.col("id").alias("doc_id"), F.lit("same words again").alias("text"), F.lit("es").alias("lang"))
    trained = {r["lang"] for r in few.filter("crc32(cast(cast(doc_id AS string) AS binary)) % 5 != 0").collect()}
    assert len(trained) > 120 and learn(few.unionByName(copies), "doc_id", "text", "lang").languages == sorted(trained)


def patterns(text):
    (group,) = word_groups([text.encode()])
    x = clause_features(group, lexicon({}), compiled())[0, :-1]
    return {PATTERNS[i] for i in np.flatnonzero(x)}


def test_grammar():
    insult, threat = 1, 2
    assert patterns("you idiot") == {(insult, False, False, True)}
    assert patterns("an idiot somewhere") == {(insult, False, False, False)}
    assert patterns("you are not an idiot") == {(insult, True, False, True)}
    assert patterns("not that I think this is so but idiot") == {(insult, False, False, False)}
    assert patterns("he said that stupid thing") == {(insult, False, True, True)}
    assert patterns("I will kill you. Nice day") == {(threat, False, False, True)}
    assert patterns("you are kind. an idiot. well") == {(insult, False, False, False)}
    assert patterns("") == patterns("nothing here") == set()


def test_toxicity(spark):
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(400):
        text = invented(rng, ["ka", "to", "mi", "re", "sol"], 60).split()
        bad = i % 5 == 0
        for _ in range(3 * bad):
            text[rng.randrange(60)] = rng.choice(["zornblatt", "zornblattig", "zornblatten", "krumvogel"])
        rows.append((i, " ".join(text)))
        labels.append((i, int(bad), 0))
    labels += [(0, 0, 0), (None, 1, 0), (777, 1, 0), (5, None, 0)]
    rows += [(900, None), (901, ""), (902, "you pathetic idiot, you moron"), (None, "x"), (5, rows[5][1]), (903, "tomi " * 50_000)]
    df = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, score double")
    marks = spark.createDataFrame(labels, "doc_id long, toxic int, text int")
    got = toxicity(df, marks).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    by = {r["doc_id"]: r for r in got}
    held = [r for r in got if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < 400]
    assert len(held) > 50 and all(r["predicted"] == (r["doc_id"] % 5 == 0) for r in held)
    assert by[902]["predicted"] == 1 and not any(by[i]["predicted"] for i in (900, 901, 903, None))
    without = {r["doc_id"]: r["predicted"] for r in toxicity(df, marks.limit(0)).collect()}
    assert without[902] == 1 and not without[900]
    assert toxicity(df.limit(0), marks).count() == 0


def test_parse():
    own, lines, passages = parse("Hi\n> one\n>> two\n> > two b\n>three\nOn Monday A wrote:\n> four\nbye")
    assert own == "Hi\nbye" and lines == ["Hi", "bye"]
    assert passages == [(1, ["one"]), (2, ["two", "two b"]), (1, ["three"]), (1, ["four"])]
    assert normalised("  A-b,\tC ") == "a b c"


def test_reply_order(spark):
    rows = [
        (1, 0, "Hello there friend\nHow are you?"), (1, 1, "Fine thanks"), (1, 2, "On Monday X wrote:\n> How  ARE you?\nstill asking"),
        (1, 3, "> > how are you\n> still asking\nok so"), (1, 4, None), (1, 5, ">>> nothing known"), (1, 6, "> ok so\nend"), (1, 7, "> end"),
        (2, 0, "> How are you?"), (2, 1, ""), (None, 0, "> x"), (2, 1, ""), (3, None, "> no turn"), (3, 0, "no turn"),
    ]
    df = spark.createDataFrame([(c, t, "u", x, "h") for c, t, x in rows], "conv_id long, turn int, role string, text string, hash string")
    got = reply_order(df).collect()
    assert len(got) == len(rows)
    one = [tuple(r[k] for k in ("turn", "text", "n_quotes", "levels", "n_linked", "reply_to", "thread", "depth"))
           for r in sorted(got, key=lambda r: r["position"]) if r["conv_id"] == 1]
    assert one == [
        (0, "Hello there friend\nHow are you?", 0, 0, 0, None, 0, 0), (2, "still asking", 1, 1, 1, 0, 0, 1), (3, "ok so", 2, 2, 2, 2, 0, 2),
        (6, "end", 1, 1, 1, 3, 0, 3), (7, "", 1, 1, 1, 6, 0, 4), (1, "Fine thanks", 0, 0, 0, None, 1, 0), (4, "", 0, 0, 0, None, 4, 0),
        (5, "", 1, 3, 0, None, 5, 0)]
    assert all(r["reply_to"] is None for r in got if r["conv_id"] != 1)
    for conv in (1, 2, 3, None):
        own = [r["position"] for r in got if r["conv_id"] == conv]
        assert sorted(own) == list(range(1, len(own) + 1))
    assert reply_order(df.limit(0)).count() == 0
