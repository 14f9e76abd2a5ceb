"""Whitespace tokenisation and token hashing as column expressions.

Tokens are whitespace words (the model's subword vocabulary is not
reproduced): ``split(trim(text), '\\s+')``. ``trim`` strips spaces only and
the split keeps empty edge tokens, the same as DuckDB's
``string_split_regex(trim(text), '\\s+')``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the reference's default token budget per text.
MAX_LENGTH = 256
# Fixed value: the padding token used when left-padding a batch.
PAD_TOKEN = "<pad>"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def whitespace_tokens(text) -> Column:
    return F.split(F.trim(_col(text)), r"\s+")


def truncate_tokens(tokens, max_length: int | None) -> Column:
    """Keep at most ``max_length`` tokens (``None`` keeps the whole text)."""
    if max_length is None:
        return _col(tokens)
    if int(max_length) < 1:
        raise ValueError("max_length must be >= 1")
    return F.slice(_col(tokens), 1, int(max_length))


def hashed_token_codes(tokens, dimension: int) -> Column:
    """Signed feature-hash code per token: ``sign * (bucket + 1)``.

    bucket = first 8 hex digits of md5(token) mod ``dimension``; sign = +1
    when the 9th hex digit is 0-7, else -1.
    """
    d = int(dimension)

    def code(h):
        bucket = F.conv(F.substring(h, 1, 8), 16, 10).cast("bigint") % d
        # hex digits 0-7 sort below '8'; 8, 9 and a-f do not
        sign = F.when(F.substring(h, 9, 1) < F.lit("8"), 1).otherwise(-1)
        return (sign * (bucket + 1)).cast("int")

    # md5 once per token: the inner transform binds the digest to a variable
    return F.transform(F.transform(_col(tokens), lambda t: F.md5(t)), code)
