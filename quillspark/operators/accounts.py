"""Users, keys and refresh tokens as tables and pure changes of them; the caller writes what comes back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import email as normal
from ..functions.tokens import active, derived_id, token_hash

ROLES = ("admin", "user")


def _set(table: DataFrame, rows: Column, **values: Column) -> DataFrame:
    return table.withColumns({c: F.when(rows, v).otherwise(F.col(c)) for c, v in values.items()})


def create_users(users: DataFrame, new: DataFrame) -> DataFrame:
    """Rows to append of new (email, full_name, role): e-mails are normalised, known ones and unknown roles are left out."""
    rows = new.select(normal(F.col("email")).alias("email"), "full_name", "role").filter(F.col("role").isin(*ROLES) & (F.col("email") != "")).dropDuplicates(["email"])
    return rows.join(users.select(normal(F.col("email")).alias("email")), "email", "left_anti").select(derived_id(F.col("email")).alias("user_id"), "email", "full_name", "role", F.lit(True).alias("is_active"))


def change_user(users: DataFrame, user_id: str, **values: str | bool) -> DataFrame:
    return _set(users, F.col("user_id") == user_id, **{c: F.lit(v) for c, v in values.items()})


def deactivate(users: DataFrame, user_id: str) -> DataFrame:
    return change_user(users, user_id, is_active=False)


def create_key(spark, name: str, user_id: str, secret: str, expires: str | None = None) -> DataFrame:
    """The row of an API key; only the secret's hash is kept."""
    return spark.range(1).select(derived_id(F.lit(name), F.lit(user_id), token_hash(F.lit(secret))).alias("key_id"), F.lit(name).alias("name"), F.lit(user_id).alias("user_id"), token_hash(F.lit(secret)).alias("key_hash"), F.lit(expires).cast("timestamp").alias("expires_at"), F.lit(True).alias("is_active"), F.lit(None).cast("timestamp").alias("last_used_at"))


def revoke_key(keys: DataFrame, key_id: str) -> DataFrame:
    return _set(keys, F.col("key_id") == key_id, is_active=F.lit(False))


def find_key(keys: DataFrame, secret: str, now: str) -> DataFrame:
    return keys.filter((F.col("key_hash") == token_hash(F.lit(secret))) & F.col("is_active") & active("expires_at", F.lit(now).cast("timestamp"), forever=True))


def used_key(keys: DataFrame, secret: str, now: str) -> DataFrame:
    return _set(keys, F.col("key_hash") == token_hash(F.lit(secret)), last_used_at=F.lit(now).cast("timestamp"))


def open_tokens(tokens: DataFrame, token: str, now: str) -> DataFrame:
    """The refresh token's row while it is neither revoked nor expired."""
    return tokens.filter((F.col("token_hash") == token_hash(F.lit(token))) & ~F.col("is_revoked") & active("expires_at", F.lit(now).cast("timestamp")))


def revoke_tokens(tokens: DataFrame, user_id: str | None = None, token: str | None = None) -> DataFrame:
    rows = F.col("user_id") == user_id if token is None else F.col("token_hash") == token_hash(F.lit(token))
    return _set(tokens, rows, is_revoked=F.lit(True))
