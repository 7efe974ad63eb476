"""Signed tokens and password hashes with the standard library, and hashes and ids as columns."""

from __future__ import annotations

import base64
import hashlib
import hmac
import json
import os
import time

from pyspark.sql import Column
from pyspark.sql import functions as F


def _b64(data: bytes) -> str:
    return base64.urlsafe_b64encode(data).rstrip(b"=").decode()


def _raw(text: str) -> bytes:
    return base64.urlsafe_b64decode(text + "=" * (-len(text) % 4))


def jwt(claims: dict, secret: str, seconds: int, now: float | None = None) -> str:
    """A token signed with HS256 that expires after so many seconds."""
    issued = int(time.time() if now is None else now)
    parts = [_b64(json.dumps(x, separators=(",", ":")).encode()) for x in ({"alg": "HS256", "typ": "JWT"}, claims | {"iat": issued, "exp": issued + seconds})]
    said = ".".join(parts)
    return f"{said}.{_b64(hmac.digest(secret.encode(), said.encode(), 'sha256'))}"


def jwt_claims(token: str, secret: str, now: float | None = None) -> dict | None:
    """The claims of a token, or None if it is broken, signed otherwise or expired."""
    try:
        said, _, mark = token.rpartition(".")
        head, body = said.split(".")
        if json.loads(_raw(head)).get("alg") != "HS256" or not hmac.compare_digest(_raw(mark), hmac.digest(secret.encode(), said.encode(), "sha256")):
            return None
        claims = json.loads(_raw(body))
    except (ValueError, KeyError, AttributeError):
        return None
    return claims if claims.get("exp", 0) > (time.time() if now is None else now) else None


def hashed_password(password: str, salt: bytes | None = None) -> str:
    salt = salt or os.urandom(16)
    return f"scrypt${_b64(salt)}${_b64(hashlib.scrypt(password.encode(), salt=salt, n=1 << 14, r=8, p=1))}"


def right_password(password: str, kept: str) -> bool:
    try:
        _, salt, _ = kept.split("$")
        return hmac.compare_digest(hashed_password(password, _raw(salt)), kept)
    except ValueError:
        return False


def token_hash(token: Column) -> Column:
    return F.sha2(token, 256)


def derived_id(*parts: Column) -> Column:
    """An id from what it names, so that a retried task makes the same: the form of a UUID."""
    h = F.md5(F.concat_ws("\x1f", *[p.cast("string") for p in parts]))
    return F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])


def active(expires: str, now: Column, forever: bool = False) -> Column:
    """Not yet expired; with forever, no expiry means none."""
    later = F.col(expires) > now
    return F.col(expires).isNull() | later if forever else F.coalesce(later, F.lit(False))
