"""S5 encryption at rest with the engine's own AES functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Header and the shortest encrypted payload.
HEADER = b"ENC1"
MIN_LENGTH = 32


def is_encrypted(col: Column) -> Column:
    return (F.octet_length(col) >= MIN_LENGTH) & (F.substring(col, 1, len(HEADER)) == F.lit(bytearray(HEADER)))


def _sealed(col: Column, key: Column) -> Column:
    # the function returns nonce, cipher text and tag in one value
    return F.concat(F.lit(bytearray(HEADER)), F.aes_encrypt(col.cast("binary"), key, F.lit("GCM"), F.lit("DEFAULT")))


def _opened(col: Column, key: Column) -> Column:
    body = F.substr(col, F.lit(len(HEADER) + 1))
    return F.aes_decrypt(body, key, F.lit("GCM"), F.lit("DEFAULT"))


def encrypt_column(df: DataFrame, col: str, key: bytes) -> DataFrame:
    return df.withColumn(col, _sealed(F.col(col), F.lit(bytearray(key))))


def decrypt_column(df: DataFrame, col: str, key: bytes) -> DataFrame:
    """Plain bytes; a payload without the header raises at run time."""
    good = F.when(is_encrypted(F.col(col)), _opened(F.col(col), F.lit(bytearray(key)))).otherwise(
        F.raise_error(F.lit("payload lacks the encryption header or is too short")).cast("binary")
    )
    return df.withColumn(col, F.when(F.col(col).isNotNull(), good))


def backfill_encrypt(df: DataFrame, col: str, key: bytes) -> DataFrame:
    """Encrypt rows that are still plain; encrypted rows pass through."""
    value = F.col(col).cast("binary")
    done = is_encrypted(value)
    out = F.when(value.isNull(), value).when(done, value).otherwise(_sealed(value, F.lit(bytearray(key))))
    return df.withColumns({"migrated": value.isNotNull() & ~done, col: out})
