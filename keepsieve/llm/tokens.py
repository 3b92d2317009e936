"""Token counts of texts under a public tokenizer, whose file is a parameter and never copied."""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Name of the default vocabulary file of the installed public tokenizers.
DEFAULT = "byte_bpe_50k.tiktoken"


@functools.cache
def _encoding(path: str):
    import public_tokenizers
    import tiktoken

    full = path if "/" in path else public_tokenizers.path(path)
    with open(full, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(text: str | None, path: str = DEFAULT) -> int:
    return len(_encoding(path).encode_ordinary(text)) if text else 0


def token_count(text: Column, path: str = DEFAULT) -> Column:
    """Tokens of each whole text; 0 for null and empty ones."""

    @F.pandas_udf("long")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoding = _encoding(path)
        for texts in batches:
            yield pd.Series([len(encoding.encode_ordinary(t)) if t else 0 for t in texts], dtype="int64")

    return of(text)
