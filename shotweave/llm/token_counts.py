"""Token counts: Arrow batches of bounded bytes, long texts split at safe boundaries, lengths only."""
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .frames import id_and_text, schema_with
from .tokens import encoder
from .words import slices, text_column


def count_tokens(docs: DataFrame, path: str, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens (the tokenizer's ids without added ones), over_limit (n_tokens > limit); one row per row of docs.

    Null and empty texts have 0 bytes and 0 tokens. Repeated rows and null ids are counted like others. Nothing is shuffled: a task reads Arrow
    batches, cuts them into ranges of about 2 MB, splits texts where a cut cannot change ids, and encodes each different piece once.
    """
    docs = id_and_text(docs)
    schema = schema_with(docs, "n_bytes long, n_tokens long, over_limit boolean")

    def run(batches):
        tool = encoder(path)
        for batch in batches:
            texts = text_column(batch)
            for i, j in slices(texts):
                part = texts.slice(i, j - i)
                counts = pa.array(tool.lengths(part))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pc.binary_length(part).cast(pa.int64()), counts, pc.greater(counts, limit)], names=schema.names)

    return docs.mapInArrow(run, schema)
