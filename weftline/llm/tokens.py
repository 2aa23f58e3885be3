"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.session import cut, spread

TOKENIZER = "byte_bpe_50k.tiktoken"


@lru_cache(maxsize=4)
def encoding(path: str):
    """The encoding of a file of ranks; `path` is a file, or the name of one of the public tokenizers."""
    import os

    import public_tokenizers as public
    import tiktoken

    if not os.path.exists(path):
        path = public.path(path)
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("weftline", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})


def n_tokens(text: Column, tokenizer: str = TOKENIZER) -> Column:
    """Number of tokens; NULL counts as no text and has 0."""

    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        enc = encoding(tokenizer)
        return pd.Series([len(x) for x in enc.encode_ordinary_batch(["" if t is None else t for t in texts], num_threads=1)], dtype="int64")

    return count(text)


def measured(documents: DataFrame, tokenizer: str = TOKENIZER, *keep: str | Column) -> DataFrame:
    """(doc_id, tokens, *keep) of the documents that have any text; NULL and blank texts have none.

    The result is cut, so that each text is tokenised once, behind the exchange that spreads a small scan, whatever is filtered
    or counted afterwards.
    """
    d = documents.where("doc_id IS NOT NULL AND text IS NOT NULL").where(~F.col("text").rlike(r"^[\s\p{Z}]*$"))
    d = spread(d.select("doc_id", "text", *keep))
    return cut(d.select("doc_id", n_tokens(F.col("text"), tokenizer).alias("tokens"), *[c for c in d.columns if c not in ("doc_id", "text")]))
