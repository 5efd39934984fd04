"""Token counts: encoding in Arrow functions that return lengths only."""

from __future__ import annotations

import base64
import os

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Bytes that are encoded at once, and characters above which a text is split.
BATCH_BYTES = 1 << 20
SPLIT_CHARS = 1 << 16
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Where a piece of PATTERN always begins, so that the parts' counts add up to the whole's: before a space between two letters,
#: between letters and digits, and where letters or digits meet other signs without a space (an apostrophe before letters excepted).
_SAFE = regex.compile(r"(?<=\p{L})(?= \p{L})|(?<=\p{L})(?=\p{N})|(?<=\p{N})(?=\p{L})|(?<=[\p{L}\p{N}])(?=[^\s\p{L}\p{N}])|(?<=[^\s\p{L}\p{N}'])(?=[\p{L}\p{N}])")
_loaded: dict = {}


def encoder(path: str):
    """The byte-pair encoder of a vocabulary file, loaded once in each Python worker."""
    if path not in _loaded:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        _loaded[path] = tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _loaded[path]


def split_safely(text: str, most: int = SPLIT_CHARS) -> list[str]:
    """Parts of about `most` characters whose token counts add up exactly; a stretch without a safe place, such as letters only,
    is one piece of PATTERN and stays whole."""
    parts, at = [], 0
    while len(text) - at > most:
        m = _SAFE.search(text, at + most)
        if not m:
            break
        parts.append(text[at : m.start()])
        at = m.start()
    return [*parts, text[at:]]


def _counter(path: str, batch_bytes: int, split_chars: int):
    def count(text: pa.Array) -> pa.Array:
        enc = encoder(path)
        out = [None if not ok else 0 for ok in text.is_valid().to_pylist()]
        batch, owners, held = [], [], 0

        def flush() -> None:
            for i, ids in zip(owners, enc.encode_ordinary_batch(batch, num_threads=1) if len(batch) > 1 else [enc.encode_ordinary(x) for x in batch]):
                out[i] += len(ids)

        for i, t in enumerate(text):
            if out[i] is None:
                continue
            for part in split_safely(t.as_py(), split_chars):
                size = len(part.encode())
                if held and held + size > batch_bytes:
                    flush()
                    batch, owners, held = [], [], 0
                batch.append(part)
                owners.append(i)
                held += size
        flush()
        return pa.array(out, pa.int64())

    return count


def with_token_counts(docs: DataFrame, text: str = "text", out: str = "n_tokens", vocabulary: str = VOCABULARY, batch_bytes: int = BATCH_BYTES, split_chars: int = SPLIT_CHARS) -> DataFrame:
    """docs with `out`, the number of tokens of each text under the vocabulary (a .tiktoken file on every machine).

    A null text gives null, an empty one 0; rows that repeat are counted each; a column already named `out`
    is replaced, others stay; an empty table stays empty. Texts longer than split_chars are split where no token can reach
    across (see _SAFE), so counts equal those of the whole text; batch_bytes are bytes of UTF-8.
    """
    return docs.withColumn(out, F.arrow_udf(_counter(vocabulary, batch_bytes, split_chars), "bigint")(F.col(text)))
