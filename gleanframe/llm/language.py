"""Language identification by a string kernel: blended n-gram presence, Nystrom landmarks, one-versus-rest ridge regression."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from gleanframe.llm.common import held_out
from gleanframe.llm.words import GROUP, LOWER, as_bytes

#: n-grams of 1 to SPECTRUM bytes share BUCKETS hashed places.
SPECTRUM, BUCKETS = 4, 1 << 16
#: Bounds of the fitted sample: labelled texts per language, landmarks in all (a language has one at least).
PER_LANGUAGE, LANDMARKS = 200, 256
RIDGE, SHARPNESS = 1e-2, 4.0
#: Texts per matrix product.
BLOCK = 64


def mark(row: np.ndarray, text: bytes) -> None:
    """Sets the places of the text's n-grams to 1, in steps of bounded memory."""
    whole = np.frombuffer(text, dtype=np.uint8)
    for at in range(0, len(whole), GROUP):
        data = LOWER[whole[at : at + GROUP + SPECTRUM - 1]]
        code = np.zeros(len(data), dtype=np.uint32)
        for n in range(1, SPECTRUM + 1):
            if len(data) < n:
                break
            code = (code[: len(data) - n + 1] << np.uint32(8)) | data[n - 1 :]
            row[((code + np.uint32(n)) * np.uint32(2654435761)) >> np.uint32(16)] = 1


class Model(NamedTuple):
    languages: list[str]
    weights: np.ndarray  #: BUCKETS x languages


def kernel(rows: np.ndarray, landmarks: np.ndarray) -> np.ndarray:
    """Normalised presence kernel: shared n-grams over the root of the product of both numbers of n-grams."""
    sizes = np.sqrt(np.maximum(rows.sum(axis=1), 1))[:, None] * np.sqrt(np.maximum(landmarks.sum(axis=1), 1))[None, :]
    return (rows @ landmarks.T) / sizes


def _rows(sets: list[np.ndarray]) -> np.ndarray:
    out = np.zeros((len(sets), BUCKETS), dtype=np.float32)
    for row, places in zip(out, sets):
        row[places] = 1
    return out


def fit(sets: list[np.ndarray], labels: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model | None:
    """sets: the places of each text's n-grams. Landmarks are taken from each language in turn."""
    languages = sorted(set(labels))
    if not languages:
        return None
    y = np.array([languages.index(label) for label in labels])
    turn = sorted(range(len(y)), key=lambda i: (int((y[:i] == y[i]).sum()), y[i]))
    marks = _rows([sets[i] for i in turn[: max(landmarks, len(languages))]])
    values, vectors = np.linalg.eigh(kernel(marks, marks).astype(np.float64))
    good = values > 1e-6 * values[-1]
    root = vectors[:, good] / np.sqrt(values[good])
    z = np.concatenate([kernel(_rows(sets[i : i + BLOCK]), marks) for i in range(0, len(sets), BLOCK)]).astype(np.float64) @ root
    target = np.where(y[:, None] == np.arange(len(languages)), 1.0, -1.0)
    share = np.sqrt(1.0 / np.bincount(y, minlength=len(languages)))[y][:, None]  # every language weighs the same
    zw = z * share
    beta = np.linalg.solve(zw.T @ zw + ridge * np.eye(z.shape[1]), zw.T @ (target * share))
    alpha = root @ beta / np.sqrt(np.maximum(marks.sum(axis=1), 1))[:, None]
    # The kernel with all landmarks and their coefficients is one product with these weights.
    return Model(languages, (marks.T @ alpha.astype(np.float32)).astype(np.float32))


def learn(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> Model | None:
    """A model of labelled rows outside the held-out fold; equal texts count once. None without such rows.

    At most PER_LANGUAGE texts of each language are used, chosen by the texts' hashes: all texts of a language that has no more.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    rows = rows.filter(~held_out(F.col("id"))).filter("lang IS NOT NULL AND text != ''")
    keyed = rows.withColumn("hash", F.xxhash64("text"))
    counts = keyed.groupBy("lang").agg(F.approx_count_distinct("hash").alias("n")).collect()
    if not counts:
        return None
    # Copies don't count: a share of the rows would draw too few texts where most rows are copies.
    share = F.create_map(*[F.lit(x) for r in counts for x in (r.lang, min(1.0, 8 * PER_LANGUAGE / max(r.n, 1)))])
    few = keyed.filter(F.pmod("hash", F.lit(1 << 20)) < share[F.col("lang")] * (1 << 20)).select("lang", "hash").distinct()
    few = few.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("hash"))).filter(F.col("k") <= PER_LANGUAGE)
    chosen = keyed.join(F.broadcast(few.select("lang", "hash")), ["lang", "hash"]).dropDuplicates(["lang", "hash"])

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = np.zeros(BUCKETS, dtype=bool)
        for batch in batches:
            found = []
            for text in as_bytes(batch.column(2)):
                row[:] = False
                mark(row, text)
                found.append(np.flatnonzero(row).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([x.tobytes() for x in found], pa.binary())], ["lang", "hash", "places"])

    sample = chosen.select("lang", "hash", F.col("text").cast("binary")).mapInArrow(places, "lang string, hash long, places binary").collect()
    sample = sorted(sample, key=lambda r: (r.lang, r.hash))
    return fit([np.frombuffer(r.places, dtype=np.int32) for r in sample], [r.lang for r in sample])


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", carry: str | None = None) -> DataFrame:
    """One row per document row: its id (or the column named by carry in its place), held_out, lang_pred, score.

    lang_pred is a language of the labelled rows outside the held-out fold, or und if the text is null or has no letter (or
    nothing could be learned), then with score 0. The score is the softmax of the one-versus-rest regressions, 0 to 1. Ties go to
    the first language in order. Labels, ids and other columns are no input of a prediction; equal texts get equal results. A
    null id is kept (its fold is that of the empty text).

    The driver fits on a sample of bounded size (see learn) and sends one matrix of BUCKETS rows and a column per language.
    Scoring is a narrow pass: presence rows of BLOCK texts times that matrix.
    """
    spark = docs.sparkSession
    carry = carry or id_col
    model = learn(docs, id_col, text_col, lang_col)
    shared = spark.sparkContext.broadcast(model and (model.languages, model.weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        rows = np.zeros((BLOCK, BUCKETS), dtype=np.float32)
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                n = part.num_rows
                texts = as_bytes(part.column(2))
                lettered = [any(map(str.isalpha, (t or b"").decode("utf-8", "replace"))) for t in texts]
                names, scores = ["und"] * n, [0.0] * n
                if known and any(lettered):
                    rows[:n] = 0
                    for row, text, ok in zip(rows, texts, lettered):
                        if ok:
                            mark(row, text)
                    block = rows[:n]
                    value = (block @ known[1]).astype(np.float64) / np.sqrt(np.maximum(block.sum(axis=1), 1))[:, None]
                    power = np.exp(SHARPNESS * (value - value.max(axis=1, keepdims=True)))
                    best = value.argmax(axis=1)
                    share = power[np.arange(n), best] / power.sum(axis=1)
                    for i in np.flatnonzero(lettered).tolist():
                        names[i], scores[i] = known[0][best[i]], float(share[i])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(names), pa.array(scores, pa.float64())], [carry, "held_out", "lang_pred", "score"])

    schema = StructType([docs.schema[carry], *StructType.fromDDL("held_out boolean, lang_pred string, score double").fields])
    return docs.select(F.col(carry), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).cast("string").cast("binary")).mapInArrow(
        run, schema)
