"""Keys, deterministic priorities, samples and splits from hashes."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions.text import SEPARATOR, collapse, strip, words


def text_key(text: Column) -> Column:
    return F.sha2(text, 256)


def stripped_key(text: Column) -> Column:
    return F.sha2(strip(text), 256)


def collapsed_key(text: Column) -> Column:
    return F.md5(collapse(text))


def prompt_key(text: Column) -> Column:
    """The key of lower-cased text with single spaces."""
    return F.sha2(collapse(F.lower(text)), 256)


def words_key(text: Column) -> Column:
    return F.sha2(F.array_join(words(text), " "), 256)


def composite_key(*parts: Column) -> Column:
    return F.sha2(F.concat_ws(SEPARATOR, *[strip(F.coalesce(p, F.lit(""))) for p in parts]), 256)


def uuid_key(value: Column) -> Column:
    """A UUID's 32 digits, however it is spelled; null if it isn't one."""
    bare = F.lower(F.regexp_replace(strip(value), r"^urn:uuid:|[{}-]", ""))
    return F.when(bare.rlike("^[0-9a-f]{32}$"), bare)


def record_key(*columns: str) -> Column:
    """The key of a whole record, as JSON with its fields in the order of their names."""
    return F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)


def priority(seed: int | str, *parts: Column) -> Column:
    """A sort key that orders rows the same random way on every run."""
    return F.sha2(F.concat_ws(SEPARATOR, F.lit(str(seed)), *[p.cast("string") for p in parts]), 256)


def uniform(seed: int | str, *parts: Column) -> Column:
    """A whole number from 0 to 2**32 - 1 for each key, uniform over keys."""
    return F.conv(F.substring(priority(seed, *parts), 1, 8), 16, 10).cast("long")


def chosen(seed: int | str, share: float, *parts: Column) -> Column:
    """Whether a key falls to a share of all keys."""
    return uniform(seed, *parts) < F.lit(int(share * 2**32))


def band(seed: int | str, share: float, *parts: Column) -> Column:
    """The number of the band, each `share` wide, that a key falls in."""
    return F.floor(uniform(seed, *parts) / F.lit(share * 2**32)).cast("int")


def hash_bucket(text: Column, buckets: int) -> Column:
    """The first 8 hex digits of a key, modulo buckets: a split that follows the text."""
    return F.pmod(F.conv(F.substring(text, 1, 8), 16, 10).cast("long"), F.lit(buckets)).cast("int")


def blake2b_udf(size: int = 16, key: bytes = b""):
    """BLAKE2b digests as hex, for keys that must equal ones published elsewhere."""

    @F.pandas_udf("string")
    def digest(text: pd.Series) -> pd.Series:
        return text.map(lambda t: None if t is None else hashlib.blake2b(t.encode(), digest_size=size, key=key).hexdigest())

    return digest
