"""Token counts; huge documents are encoded in overlapping chunks that resynchronise."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retail_lake.llm.common import rows
from retail_lake.llm.tokens import BYTE_BPE, Pieces, blank_pieces, chunked_spans, load

CHUNK_CHARS = 1 << 14
OVERLAP_CHARS = 256
SLICE = 500


def token_counts(
    docs: DataFrame, path: str = BYTE_BPE, limit: int = 1024, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS
) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit, n_chunks`` of every document (null text: empty).

    ``path`` names a byte-level BPE file of the tokenizers library, present on every executor.
    Texts of more than ``chunk`` characters are encoded in chunks of that size with at least
    ``overlap`` characters in common (see ``tokens.chunked_spans``); memory holds one document
    and the tokens of two chunks.  One row per input row; columns beyond ``doc_id`` and ``text``
    are not read; a null doc_id stays null.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(load(path), blank_pieces)
        schema = pa.schema(
            [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_()), ("n_chunks", pa.int32())]
        )
        for whole in batches:
            for k in range(0, whole.num_rows, SLICE):
                batch = whole.slice(k, SLICE)
                texts = batch.column("text").to_pylist()
                tokens = pieces.counts([t if len(t) <= chunk else "" for t in texts])
                chunks = np.ones(len(texts), np.int32)
                for at, text in enumerate(texts):
                    if len(text) > chunk:
                        spans = [n for _, _, n in chunked_spans(pieces, text, chunk, overlap)]
                        tokens[at], chunks[at] = sum(spans), len(spans)
                yield rows(schema, [batch.column("doc_id"), batch.column("n_bytes"), tokens, tokens > limit, chunks])

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(
        F.col("doc_id").cast("long"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text")
    ).mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean, n_chunks int")
