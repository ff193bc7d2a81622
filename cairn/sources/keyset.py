"""The keyset of a computer, opened on the driver once, and keys as a relation.

Keys travel as rows of a local relation, never as literals, so plans and logs do not show them. The ciphers are the
JVM's own.
"""

from __future__ import annotations

import hashlib
import hmac
import struct
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions.envelope import HEADER, IV_AT, MAC_AT

# Fixed values of the format: magics, field sizes, rounds of the key derivation, version of the plaintext.
KEYSET_MAGIC, OBJECT_MAGIC = b"ARQ_ENCRYPTED_MASTER_KEYS", b"ARQO"
SALT, MAC, IV, FIELD = 8, 32, 16, 32
ROUNDS, VERSION = 200_000, 3
KEYSET_HEADER = len(KEYSET_MAGIC) + SALT + MAC + IV


@dataclass(frozen=True)
class Keyset:
    encryption_key: bytes
    hmac_key: bytes
    salt: bytes


class KeysetError(ValueError):
    """A keyset that does not open; ``rule`` is the invariant that it breaks."""

    def __init__(self, rule: str, message: str):
        super().__init__(message)
        self.rule = rule


def _cipher(spark: SparkSession, mode: int, key: bytes, iv: bytes, data: bytes) -> bytes:
    crypto = spark.sparkContext._jvm.javax.crypto
    cipher = crypto.Cipher.getInstance("AES/CBC/PKCS5Padding")
    cipher.init(mode, crypto.spec.SecretKeySpec(key, "AES"), crypto.spec.IvParameterSpec(iv))
    return bytes(cipher.doFinal(data))


def derived(password: str, salt: bytes) -> tuple[bytes, bytes]:
    """The cipher key and the mac key of a password."""
    both = hashlib.pbkdf2_hmac("sha256", password.encode(), salt, ROUNDS, 2 * FIELD)
    return both[:FIELD], both[FIELD:]


def open_keyset(spark: SparkSession, blob: bytes, password: str) -> Keyset:
    """The keys of a keyset file: magic | salt | mac | iv | ciphertext, then version and three fields with lengths."""
    if not blob.startswith(KEYSET_MAGIC):
        raise KeysetError("C1", "no keyset magic")
    body = blob[KEYSET_HEADER:]
    if not body or len(body) % 16:
        raise KeysetError("C2", "the ciphertext is not a whole number of blocks")
    at = len(KEYSET_MAGIC)
    salt, mac, iv = blob[at : at + SALT], blob[at + SALT : at + SALT + MAC], blob[at + SALT + MAC : KEYSET_HEADER]
    key, mac_key = derived(password, salt)
    if not hmac.compare_digest(hmac.new(mac_key, iv + body, hashlib.sha256).digest(), mac):
        raise KeysetError("C3", "the mac differs: a wrong password, or a damaged file")
    try:
        plain = _cipher(spark, 2, key, iv, body)
    except Exception as e:  # the JVM's exception for a bad padding
        raise KeysetError("C3", "the keyset does not decrypt") from e
    if len(plain) < 4 + 3 * (8 + FIELD) or struct.unpack_from(">I", plain)[0] != VERSION:
        raise KeysetError("C4", "another version, or cut off")
    fields = [struct.unpack_from(f">Q{FIELD}s", plain, 4 + i * (8 + FIELD)) for i in range(3)]
    if any(n != FIELD for n, _ in fields):
        raise KeysetError("C4", "a key of another length")
    return Keyset(*[f for _, f in fields])


def keys(spark: SparkSession, keysets: dict[str, Keyset]) -> DataFrame:
    """(cu, encryption_key, salt, and the mac key's two paddings): one row a computer."""
    pad = lambda key, x: bytes(b ^ x for b in key.ljust(64, b"\0"))
    rows = [(cu, k.encryption_key, k.salt, pad(k.hmac_key, 0x36), pad(k.hmac_key, 0x5C)) for cu, k in keysets.items()]
    return spark.createDataFrame(rows, "cu string, encryption_key binary, salt binary, inner_pad binary, outer_pad binary")


def has_magic(content: Column, magic: bytes = OBJECT_MAGIC) -> Column:
    return F.coalesce(F.substring(content, 1, len(magic)) == F.lit(magic), F.lit(False))


def mac_ok(content: Column, inner: Column, outer: Column) -> Column:
    """X1 by the keys of the row: the magic is there and the mac is that of what follows it."""
    body = F.substring(content, IV_AT + 1, F.octet_length(content))
    mac = F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, body), 256))), 256)
    same = mac == F.lower(F.hex(F.substring(content, MAC_AT + 1, 32)))
    return F.when(has_magic(content) & (F.octet_length(content) >= HEADER + 16), F.coalesce(same, F.lit(False))).otherwise(F.lit(False))


def opened(content: Column, key: Column) -> Column:
    """X2 by the keys of the row: the plaintext, or null."""
    cbc, pkcs = F.lit("CBC"), F.lit("PKCS")
    session = F.try_aes_decrypt(F.substring(content, IV_AT + 1, HEADER - IV_AT), key, cbc, pkcs)
    body = F.concat(F.substring(session, 1, IV), F.substring(content, HEADER + 1, F.octet_length(content)))
    return F.try_aes_decrypt(body, F.substring(session, IV + 1, FIELD), cbc, pkcs)


def sidecars(files: DataFrame, keyrings: DataFrame, content: str = "content") -> DataFrame:
    """Files (cu, ...) with ``document``, their JSON as text: plain, or encrypted if the magic is there. Null on any
    failure: no keys for it, a wrong mac, no plaintext, no JSON object."""
    c = F.col(content)
    j = files.join(keyrings, "cu", "left")
    plain = F.when(has_magic(c), F.when(F.col("inner_pad").isNotNull() & mac_ok(c, F.col("inner_pad"), F.col("outer_pad")), opened(c, F.col("encryption_key")))).otherwise(c)
    text = F.when(F.is_valid_utf8(plain.cast("string")), plain.cast("string"))
    document = F.when(F.try_parse_json(text).isNotNull() & F.schema_of_variant(F.try_parse_json(text)).startswith("OBJECT"), text)
    return j.withColumn("document", document).drop(*[k for k in keyrings.columns if k != "cu"])


def pack_objects(entries: DataFrame, packs: DataFrame, keyrings: DataFrame, skip_truncated: bool = False) -> DataFrame:
    """(path, ordinal, offset, length, plain, problem) of the entries of packs, verified and then opened.

    ``entries`` has (path, ordinal, offset, length, truncated), ``packs`` has (cu, path, content). ``problem`` is 'truncated', 'mac mismatch' or
    'no plaintext', null if there is none; truncated entries are left out if they are to be skipped.
    """
    e = entries.join(packs.select("cu", "path", "content"), "path").join(keyrings, "cu", "left")
    e = e.where(~F.col("truncated")) if skip_truncated else e
    e = e.withColumn("_object", F.expr("substring(content, int(offset + 1), int(length))")).drop("content")
    good = F.coalesce(mac_ok(F.col("_object"), F.col("inner_pad"), F.col("outer_pad")), F.lit(False))
    e = e.withColumn("_ok", good).withColumn("plain", F.when(F.col("_ok"), opened(F.col("_object"), F.col("encryption_key"))))
    problem = F.when(F.col("truncated"), "truncated").when(~F.col("_ok"), "mac mismatch").when(F.col("plain").isNull(), "no plaintext")
    return e.select("path", "ordinal", "offset", "length", "plain", problem.alias("problem"))
