"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

TOKENIZERS = "/opt/tokenizers"
AT_ONCE = 4_000_000  # characters handed to the tokenizer together


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", extra: dict | None = None, tokenizers: str = TOKENIZERS) -> DataFrame:
    """(id, extra..., tokens), one row per row of `docs`; a null text has 0 tokens. Whole texts are encoded."""
    extra = extra or {}
    rows = docs.select(docs[f"`{id_col}`"].cast("long").alias("id"), *[c.alias(n) for n, c in extra.items()], docs[f"`{text_col}`"].cast("string").alias("__text"))
    names = ["id", *extra]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=f"{tokenizers}/piece_bpe_32k.model")
        for b in batches:
            if b.num_rows:
                texts = [t or "" for t in b.column("__text").to_pylist()]
                sizes, lo = np.zeros(len(texts), dtype=np.int64), 0
                while lo < len(texts):
                    hi, held = lo + 1, len(texts[lo])
                    while hi < len(texts) and held < AT_ONCE:
                        held += len(texts[hi])
                        hi += 1
                    sizes[lo:hi] = [len(x) for x in model.encode(texts[lo:hi], num_threads=1)]
                    lo = hi
                yield pa.RecordBatch.from_arrays([*[b.column(n) for n in names], pa.array(sizes)], [*names, "tokens"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(run, f"{kinds}, tokens long")
