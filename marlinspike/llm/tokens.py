"""Token counts by a public tokenizer whose vocabulary files lie outside the repository."""

from __future__ import annotations

import base64
import os
from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlinspike.session import ensure_checkpoint_dir

TOKENIZERS = os.environ.get("MARLINSPIKE_TOKENIZERS", "/opt/tokenizers")
#: The split pattern the byte-level vocabulary was made with; a fixed value.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""


@lru_cache(2)
def tokenizer(folder: str = TOKENIZERS, name: str = "byte_bpe_50k.tiktoken"):
    """A byte-level tokenizer from its ranks file; special strings in a text are ordinary text."""
    import tiktoken

    with open(os.path.join(folder, name), "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(documents: DataFrame, id_column: str = "doc_id", text: str = "text", keep: tuple[str, ...] = (), folder: str = TOKENIZERS, features: dict[str, Callable[[list[str]], list]] | None = None) -> DataFrame:
    """(id, keep..., features..., tokens) with each document once, checkpointed so that no text is read twice.

    features: column -> function from a list of texts to as many strings or nulls, run in the same pass.

    Whole texts are counted; null and empty texts have 0 tokens; null ids drop out. Texts don't leave their
    task; only ids, kept columns and counts are shuffled to drop rows delivered twice.
    """
    ensure_checkpoint_dir(documents.sparkSession)
    extra = features or {}
    kept = {c: documents.schema[c].dataType for c in keep}

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = tokenizer(folder)
        for frame in frames:
            sizes = []
            texts = [x or "" for x in frame.pop("text").tolist()]
            for lo in range(0, len(texts), 64):
                sizes += [len(t) for t in enc.encode_ordinary_batch(texts[lo : lo + 64], num_threads=1)]
            added = {name: pd.Series(of(texts), index=frame.index, dtype="object") for name, of in extra.items()}
            yield frame.assign(**added, tokens=pd.Series(sizes, index=frame.index, dtype="int64"))

    rows = documents.where(F.col(id_column).isNotNull()).select(F.col(id_column).alias("id"), *keep, F.col(text).alias("text"))
    schema = ", ".join([f"id {documents.schema[id_column].dataType.simpleString()}", *(f"`{c}` {t.simpleString()}" for c, t in kept.items()), *(f"`{c}` string" for c in extra), "tokens long"])
    return rows.mapInPandas(run, schema).dropDuplicates(["id"]).checkpoint()
