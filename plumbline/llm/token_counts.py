"""Token counts (operator 8): Arrow functions that return lengths only.

Batches are balanced by bytes of text, not rows; long texts are cut where no token can cross, so the counts are
those of the library for the whole text, special strings included. Null text counts as empty (0 tokens); rows
with a null or repeated id stay rows of their own; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.byte_words import per_text, slices, text_bytes
from plumbline.llm.tokenizing import encoder, spaced_stretches


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 512) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of every text, by the byte-level BPE tokenizer in the file `path`."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            data, at = text_bytes(part.column("text"))
            starts, ends, bounds = spaced_stretches(data, at)
            known = encoder(path)
            tokens = per_text(known.lengths(known.rows(data, starts, ends)), bounds, "int64")
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), pa.array(at[1:] - at[:-1]), pa.array(tokens), pa.array(tokens > limit)],
                names=[id_col, "n_bytes", "n_tokens", "over_limit"],
            )

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(count, f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean")
