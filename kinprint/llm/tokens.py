"""Token counts of texts by a public tokenizer."""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinprint.session import spread

#: Where the vocabulary files lie on every machine; the ranks file is read by each worker once.
VOCABULARY = os.environ.get("TOKENIZER_FILE", "/opt/tokenizers/byte_bpe_50k.tiktoken")
#: The published split pattern of this vocabulary (a fixed value).
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_LOADED: dict = {}
_PIECE = 20_000
_SURE = re.compile(r"(?<=[A-Za-z0-9])[ \n]")


def encoder(path: str = VOCABULARY):
    """The tokenizer of a ranks file, loaded once a process."""
    if path not in _LOADED:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _LOADED[path] = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _LOADED[path]


def token_count(enc, text: str | None) -> int:
    """Tokens of the whole text; null and empty texts have none.

    A long text is encoded in pieces of about 20 000 characters so that memory stays
    bounded.  It is cut only where a blank or line feed follows a letter or digit: no
    alternative of the split pattern reaches over such a place or looks beyond it, so
    the count is that of the text encoded at once.  Without such a place it is not cut.
    """
    if not text:
        return 0
    total, at = 0, 0
    while at < len(text):
        cut = _SURE.search(text, at + _PIECE)
        end = cut.start() if cut else len(text)
        total += len(enc.encode_ordinary(text[at:end]))
        at = end
    return total


def _counter(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            total, prompt = [], []
            for text in batch.column(batch.num_columns - 1).to_pylist():
                n = token_count(enc, text)
                line = text.split("\n", 1)[0] if text and "\n" in text else ""
                total.append(n)
                prompt.append(min(n, token_count(enc, line)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(total, pa.int32()), pa.array(prompt, pa.int32())], names=[*batch.schema.names[:-1], "n_tokens", "n_prompt"])

    return run


def with_token_counts(df: DataFrame, text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """df without the text, with n_tokens and n_prompt (tokens of the first line, if others follow).

    Null and empty texts have 0 tokens.  Other columns are kept; df must not have these two names.
    """
    keep = [c for c in df.columns if c != text]
    rows = df.select(*keep, F.col(text))
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != text)
    return spread(rows).mapInArrow(_counter(vocabulary), f"{ddl}, n_tokens int, n_prompt int")
