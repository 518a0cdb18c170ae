"""Byte-level BPE by the tiktoken library with a local rank file."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanframe.llm.words import as_bytes

#: Characters per piece of a long text.
PIECE = 1 << 16
#: No alternative of the pattern joins a character with a white space after it, nor one of these letters with an ASCII
#: sign or CJK punctuation after it, and none looks back: a match ends there whatever surrounds it.
SAFE = regex.compile(r"\S(?=\s)|[A-Za-zぁ-ゖァ-ヺ一-龥](?=[!-/:-@\[-`{-~、。！，？])")


@cache
def encoding(rank_file: str, pattern: str):
    """One per worker process, for which the workers need this package. The file must lie on every worker, as an installed
    package's files do."""
    import tiktoken

    with open(rank_file, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def pieces(text: str, size: int = PIECE) -> Iterator[str]:
    """The text in pieces of about size characters, cut only where a match of the pattern ends in any case."""
    at = 0
    while len(text) - at > size:
        cut = SAFE.search(text, at + size - 1)
        if cut is None:
            break
        yield text[at : cut.end()]
        at = cut.end()
    yield text[at:]


def encode(enc, text: str, size: int = PIECE) -> np.ndarray:
    """Ids as little-endian unsigned 32-bit integers."""
    return np.concatenate([np.asarray(enc.encode_ordinary(piece), dtype="<u4") for piece in pieces(text, size)])


def decode(enc, ids: np.ndarray) -> bytes:
    """The raw bytes of the tokens; they need not be UTF-8 where a caller cuts ids."""
    return b"".join(enc.decode_bytes(ids[i : i + PIECE].tolist()) for i in range(0, len(ids), PIECE))


def encode_documents(docs: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text",
                     with_ids: bool = False) -> DataFrame:
    """One row per input row: the id under its own name, n_tokens, ids_sha256, decoded_sha256, and ids if asked for.

    Whole texts are encoded, each match of the pattern separately and without special tokens, then decoded again. A null text
    counts as empty: no ids, and the digests of the empty string. Bytes that are no UTF-8 count as U+FFFD. Equal rows give equal
    rows; other columns are not looked at. A narrow pass over (id, text): nothing is shuffled.
    """
    kind = docs.schema[id_col].dataType
    name = id_col

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(rank_file, pattern)
        for batch in batches:
            for part in (batch.slice(i, 512) for i in range(0, batch.num_rows, 512)):
                counts, digests, decoded, all_ids = [], [], [], []
                for text in as_bytes(part.column(1)):
                    ids = encode(enc, (text or b"").decode("utf-8", "replace"))
                    counts.append(len(ids))
                    digests.append(hashlib.sha256(ids.tobytes()).hexdigest())
                    decoded.append(hashlib.sha256(decode(enc, ids)).hexdigest())
                    if with_ids:
                        all_ids.append(ids.astype(np.int32))
                columns = [part.column(0), pa.array(counts, pa.int64()), pa.array(digests), pa.array(decoded)]
                names = [name, "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    offsets = np.cumsum([0, *counts]).astype(np.int32)
                    columns.append(pa.ListArray.from_arrays(offsets, np.concatenate(all_ids)))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    schema = f"`{name}` {kind.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return docs.select(F.col(id_col), F.col(text_col).cast("string").cast("binary")).mapInArrow(run, schema)
