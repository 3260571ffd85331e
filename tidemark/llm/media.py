"""Documents as lossless images: stored, read back, features of the samples."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.text_batches import record_batch, slices
from tidemark.llm.webp import WIDTH, decode_payload, encode_payload, feature_of


def store_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes (of the text in UTF-8), media (a gray lossless WebP image of the bytes).

    Spaces fill the last row of pixels; a null or empty text is one row of spaces. Images are 192 pixels wide, of texts
    of over 3 MB a multiple of it. Equal texts have equal images; repeated rows and null ids stay; other columns are
    left out; an empty table gives an empty result.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])

    def run(batches):
        for batch in slices(batches):
            raw = [t.encode() if t else b"" for t in batch.column(1).to_pylist()]
            yield record_batch(schema, [batch.column(0), [len(r) for r in raw], [encode_payload(r + b" " * (-len(r) % WIDTH or (0 if r else WIDTH))) for r in raw]])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def read_media(stored: DataFrame) -> DataFrame:
    """stored (doc_id, n_bytes, media) with payload, the samples that the image holds for the text and the spaces up to a
    positive multiple of 192, and `feature` of them. An empty table gives an empty result."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary()), ("payload", pa.binary()), ("feature", pa.string())])

    def run(batches):
        for batch in slices(batches):
            samples = [decode_payload(m, max(1, -(-n // WIDTH)) * WIDTH) for n, m in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield record_batch(schema, [*batch.columns, [s.tobytes() for s in samples], [feature_of(s) for s in samples]])

    return stored.select("doc_id", "n_bytes", "media").mapInArrow(run, "doc_id long, n_bytes long, media binary, payload binary, feature string")
