"""Token counts of whole texts, by batches of the tokenizers library."""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from latticework.llm.common import balanced, documents, tidied

#: Blanks and line feeds never belong to a token of the word tokenizer, join no neighbour when characters are
#: composed, and occur in no special string, so a text can be cut at each of them.
_loaded: dict = {}


def _tokenizer(path: str):
    if path not in _loaded:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        found = Tokenizer.from_file(path)
        found.no_truncation()
        found.no_padding()
        _loaded[path] = (found, {"": 0})
    return _loaded[path]


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text",
                 batch_bytes: int = 2 << 20, most_known: int = 400_000) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (n_tokens > limit) of each row of docs.

    Arrow batches are cut into parts of about batch_bytes of text; each text is split at its blanks, where the
    tokenizer always ends a token, and only pieces not met before go through encode_batch, which hands back lengths.
    A worker forgets its pieces beyond most_known. Null texts count as empty (0 bytes, 0 tokens), null ids stay,
    repeated rows come out as often as they went in, an empty table gives an empty table; other columns are ignored.
    """
    src = documents(docs, id_col, text_col)
    schema = T.StructType([src.schema["doc_id"], T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())])

    def run(batches):
        tokenizer, known = _tokenizer(vocabulary)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for i, j in balanced(texts, batch_bytes):
                rows = [t or "" for t in texts.slice(i, j - i).to_pylist()]
                parts = [t.replace("\n", " ").split(" ") for t in rows]
                if len(known) > most_known:
                    known.clear()
                new = [p for p in set(chain.from_iterable(parts)) if p not in known]
                for k in range(0, len(new), 4096):
                    some = new[k : k + 4096]
                    known.update(zip(some, map(len, tokenizer.encode_batch_fast(some, add_special_tokens=False)), strict=True))
                n = np.fromiter((sum(map(known.__getitem__, p)) for p in parts), np.int64, len(parts))
                size = np.fromiter((len(t.encode()) for t in rows), np.int64, len(rows))
                yield pa.RecordBatch.from_arrays([ids.slice(i, j - i), pa.array(size), pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return src.mapInArrow(tidied(run), schema)
