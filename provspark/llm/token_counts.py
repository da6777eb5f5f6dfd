"""Token counts of documents.

Defined results: a null or empty text has no tokens; repeated rows repeat; a null doc_id stays null; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame

from provspark.llm.common import batch, ids_of, keyed, map_batches, text_bytes
from provspark.llm.tokens import HUGE, counts, shared_words

LIMIT = 2048
COUNTS = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])


def counted(docs: DataFrame, tokenizer: str = "", limit: int = LIMIT, huge: int = HUGE) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit. tokenizer: a path that all workers have; none: the installed one.

    Texts of more than huge bytes are encoded in overlapping chunks; see tokens.splice().
    """

    def make():
        words = shared_words(tokenizer)

        def f(rows: pa.RecordBatch) -> pa.RecordBatch:
            texts = text_bytes(rows.column("text"))
            n = counts(texts, words, huge)
            return batch(COUNTS, doc_id=ids_of(rows), n_bytes=[len(x) for x in texts], n_tokens=n, over_limit=[x > limit for x in n])

        return f

    return map_batches(keyed(docs), ["doc_id", "text"], make, "doc_id long, n_bytes long, n_tokens long, over_limit boolean", remembers=True)
