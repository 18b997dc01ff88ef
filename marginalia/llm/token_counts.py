"""Token counts: the number of tokens of every whole text, as a tokenizer file's own library gives them.

Runs as one Arrow function per partition. Texts are taken in slices balanced by bytes and cut at places
where the tokenizer always cuts; unseen pieces are encoded in byte-balanced batches; only lengths leave
the function. No shuffle, memory bounded by the slice and the remembered pieces.

Defined cases: a null text has 0 bytes and 0 tokens; an empty text has 0; a null id stays null; repeated
rows are counted each; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm import pieces
from marginalia.llm.common import bound_batches, lean, slices, texts_of

LIMIT = 1024


def _lengths(path: str):
    """A function from texts to their token counts, by the kind of file."""
    if path.endswith(".json"):
        return pieces.encoder(path).count
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: np.array([len(x) for x in model.encode(texts, num_threads=1)], np.int64)
    if path.endswith(".tiktoken"):
        import public_tokenizers
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
        coder = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        return lambda texts: np.array([len(coder.encode_ordinary(x)) for x in texts], np.int64)
    raise ValueError(f"no library is known for {path}")


def count_tokens(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """``id_col, n_bytes, n_tokens, over_limit`` for every row of ``docs``."""

    def run(batches):
        lengths = _lengths(tokenizer)
        for batch in batches:
            for part in slices(batch, "text"):
                texts = texts_of(part)
                sizes = pc.fill_null(pc.binary_length(part.column("text")), 0).cast(pa.int64())
                n = pa.array(lengths(texts), pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("id"), sizes, n, pc.greater(n, limit)], ["id", "n_bytes", "n_tokens", "over_limit"])

    bound_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(lean(run), f"id {kind}, n_bytes long, n_tokens long, over_limit boolean").withColumnRenamed("id", id_col)
