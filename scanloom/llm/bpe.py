"""Byte-level BPE encoding and decoding with a rank file.

``encode`` gives each document its token ids, ``decode`` gives ids back as raw bytes. Long texts are
cut where no match of the pattern can cross: between an ASCII letter or digit and a space or line feed.
No alternative of the pattern takes white space after anything else and none looks back, so the pieces'
ids put together are the ids of the whole text. Null and empty texts have no ids and decode to no bytes.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from scanloom.llm import texts

#: A rank file above this is refused: it is sent to every task.
MOST_RANK_BYTES = 64 << 20
PIECE_CHARS = 1 << 16
_SAFE = re.compile(r"(?<=[A-Za-z0-9])(?=[ \n])")


def rank_bytes(path: str) -> bytes:
    with open(path, "rb") as f:
        data = f.read(MOST_RANK_BYTES + 1)
    if len(data) > MOST_RANK_BYTES:
        raise ValueError(f"{path} is larger than {MOST_RANK_BYTES} bytes")
    return data


def encoding(data: bytes, pattern: str):
    import tiktoken

    ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, data.splitlines()) if token}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def pieces(text: str, most: int = PIECE_CHARS) -> Iterator[str]:
    start = 0
    while len(text) - start > most:
        cut = _SAFE.search(text, start + most)
        if cut is None:
            break
        yield text[start:cut.start()]
        start = cut.start()
    yield text[start:]


def encode_text(enc, text: str) -> list[int]:
    if len(text) <= PIECE_CHARS:
        return enc.encode_ordinary(text)
    return [i for piece in pieces(text) for i in enc.encode_ordinary(piece)]


def _shared(spark: SparkSession, path: str):
    return spark.sparkContext.broadcast(rank_bytes(path))


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, text (as given, null: empty), ids (array of int)."""
    shared = _shared(docs.sparkSession, path)

    def run(batches):
        enc = encoding(shared.value, pattern)
        for part in texts.slices(batches, most=texts.SMALL_SLICE_BYTES):
            ids = [encode_text(enc, t) for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "text", "ids"])

    return texts.id_text(docs).mapInArrow(run, "doc_id long, text string, ids array<int>")


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """``encoded`` with ``raw``, the bytes of the ids (null ids: no bytes)."""
    shared = _shared(encoded.sparkSession, path)

    def run(batches):
        enc = encoding(shared.value, pattern)
        for batch in batches:
            raw = [enc.decode_bytes(ids or []) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(raw, pa.binary())], [*batch.schema.names, "raw"])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema)
    return encoded.mapInArrow(run, kept + ", raw binary")


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Token count and digests of the ids and of the bytes they decode to, ids and bytes never leaving the task."""
    shared = _shared(docs.sparkSession, path)

    def run(batches):
        enc = encoding(shared.value, pattern)
        for part in texts.slices(batches, most=texts.SMALL_SLICE_BYTES):
            counts, ids_sha, raw_sha = [], [], []
            for t in part.column("text").to_pylist():
                ids = encode_text(enc, t)
                counts.append(len(ids))
                ids_sha.append(hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
                raw_sha.append(hashlib.sha256(enc.decode_bytes(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(counts, pa.int64()), pa.array(ids_sha), pa.array(raw_sha)],
                                             ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return texts.id_text(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
