"""Feed output location: hex PBKDF2-HMAC-SHA512 of (subscriber + receiver) with salt
(salt + ordinal).

The hash is deliberately slow, so it is computed once per *feed* -- an Arrow-batched pandas
UDF over the feeds table, joined to the hits afterwards -- never once per hit row.  The
salt is a secret: it travels inside the UDF closure and is never logged or put in a column.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, functions as F

# Hash algorithm, rounds and key length of the location scheme
HASH_NAME = "sha512"
ROUNDS = 100_000


def location_hash(salt: str, ordinal: str, subscriber: str, receiver: str) -> str:
    return hashlib.pbkdf2_hmac(
        HASH_NAME,
        (subscriber + receiver).encode("utf-8"),
        (salt + ordinal).encode("utf-8"),
        ROUNDS,
    ).hex()


def location_column(salt: str, ordinal, subscriber, receiver) -> Column:
    """Column of location hashes; null when any input is null."""

    @F.pandas_udf("string")
    def _loc(o: pd.Series, s: pd.Series, r: pd.Series) -> pd.Series:
        return pd.Series(
            [None if (a is None or b is None or c is None) else location_hash(salt, a, b, c)
             for a, b, c in zip(o, s, r)],
            dtype="object",
        )

    col = lambda c: F.col(c) if isinstance(c, str) else c
    return _loc(col(ordinal).cast("string"), col(subscriber).cast("string"), col(receiver).cast("string"))
