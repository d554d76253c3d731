"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Where the public vocabularies are; every function takes another path as a parameter.
TOKENIZER = os.environ.get("PLATTERKIT_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.json")
#: Characters encoded at once, which bounds a worker's memory; longer texts are encoded alone.
BATCH_CHARS = 1_000_000


def with_tokens(df: DataFrame, text: str, tokenizer: str = TOKENIZER, size: str = "n_tokens") -> DataFrame:
    """``df`` without its text column, with the text's length in tokens as ``size`` (long); a null text has 0.

    Whole texts are encoded; strings that look like special tokens count as ordinary text. The vocabulary file must lie at the
    same path on every executor.

    Plan: one Arrow pass that leaves the text behind, so nothing after it shuffles text.
    """
    kept = [c for c in df.columns if c not in (text, size)]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name in kept) + f", `{size}` long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(tokenizer)
        t.encode_special_tokens = True
        t.no_truncation()

        def sizes(texts: list[str | None]) -> Iterator[int]:
            part: list[str] = []
            held = 0
            for x in texts:
                part.append(x or "")
                held += len(part[-1])
                if held >= BATCH_CHARS:
                    yield from (len(e) for e in t.encode_batch_fast(part, add_special_tokens=False))
                    part, held = [], 0
            if part:
                yield from (len(e) for e in t.encode_batch_fast(part, add_special_tokens=False))

        for batch in batches:
            n = pa.array(list(sizes(batch.column(batch.schema.names.index(text)).to_pylist())), pa.int64())
            yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.names.index(c)) for c in kept], n], names=[*kept, size])

    return df.select(*kept, text).mapInArrow(run, schema)
