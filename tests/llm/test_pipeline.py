"""The pipeline's stages on planted documents, and the registered queries against their SQL."""

import os
import random

import duckdb
import pytest

import __spark_entry__ as registry
import corpus_pipeline
from test_registered import plain

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(12)
    syllables = {"aa": ["ka", "to", "mi", "re", "su"], "bb": ["sch", "ung", "der", "ein", "ach"]}
    prose = lambda k, n: " ".join("".join(rng.choice(syllables[k]) for _ in range(rng.randint(1, 4))) for _ in range(n))
    clean = [(i, prose("ab"[i % 2] * 2, 60), "ab"[i % 2] * 2) for i in range(60)]
    item = prose("aa", 25)
    near = clean[4][1].split()
    near[30] = "tomika"
    rows = clean + [(100, clean[0][1], "aa"), (101, clean[0][1], "aa"), (101, clean[0][1], "aa"), (102, " ".join(near), "aa"), (103, "12 34", None), (104, None, "aa"),
                    (105, clean[7][1] + " " + item, "bb"), (106, "kurz", None)]
    path = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame([(*r, "s", 0, "x") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, kept string").write.parquet(
        f"{path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, rows


def test_stages(spark, folder, tmp_path):
    path, rows = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns, kept = docs.columns, []
    for k, (_, step) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = step(spark, docs, path)
        assert out.columns == columns
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        kept.append(sorted(r["doc_id"] for r in docs.collect()))
    ids = sorted(r[0] for r in rows)
    assert kept[0] == [i for i in ids if i not in (103, 104)]
    assert kept[1] == sorted([i for i in range(1, 60)] + [101, 102, 105, 106])
    assert kept[2] == sorted([i for i in range(1, 60)] + [101, 105, 106])
    assert kept[3] == sorted([i for i in range(1, 60)] + [101, 106])
    final = corpus_pipeline.run(spark, path).collect()
    assert sorted(r["doc_id"] for r in final) == kept[3] and all(len(r["ids"]) == r["n_tokens"] > 0 for r in final)


def test_without_labels_nobody_is_rejected_for_a_language(spark, folder):
    docs = spark.createDataFrame([(1, "some text", None, 1), (2, "12 34", None, 1), (3, None, None, 1), (4, "日本", None, 1)],
                                 "doc_id long, text string, lang string, n_chars int")
    assert sorted(r["doc_id"] for r in corpus_pipeline.known_languages(spark, docs, folder[0]).collect()) == [1, 4]


def test_rows_that_are_not_read_from_files(spark, folder):
    rows = [(1, "same text here", "aa"), (1, "same text here", "aa"), (None, "same text here", "aa"), (None, "other", "aa")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert sorted((tuple(r) for r in corpus_pipeline.exact_once(spark, docs, folder[0]).collect()), key=repr) == [
        (1, "same text here", "aa"), (None, "other", "aa")]


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="test tables are not at hand")
@pytest.mark.parametrize("name", ["op2_warc", "op3_exact_dedup", "op4_url_filters", "op8_decontaminate", "op11_spelling_variants", "op13_resample"])
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SMALL):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SMALL}/{f}'")
    df = registry.queries()[name](spark, SMALL)
    columns = sorted(df.columns)
    cursor = con.execute(registry.oracle_sql()[name])
    at = [[d[0] for d in cursor.description].index(c) for c in columns]
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in cursor.fetchall()), key=repr)
