"""Object envelopes as columns and Arrow functions.

An envelope is magic[4] | mac[32] | iv[16] | session[64] | ciphertext. The magic is a parameter. The column forms stay
in whole-stage code and are for keys that may be seen in a plan (tests, synthetic stores); the Arrow forms keep keys in
a broadcast, out of plans and logs.
"""

import gzip
import hashlib
import hmac

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

HEADER, MAC_AT, IV_AT, SESSION_AT = 116, 4, 36, 52
#: Compression codes, fixed values.
NONE, GZIP, LZ4 = 0, 1, 2


def hmac_sha256(key: bytes, body: Column) -> Column:
    """HMAC-SHA256 from two SHA-256 calls; hexadecimal."""
    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = bytes(b ^ 0x36 for b in key), bytes(b ^ 0x5C for b in key)
    return F.sha2(F.concat(F.lit(outer), F.unhex(F.sha2(F.concat(F.lit(inner), body), 256))), 256)


def envelope_ok(envelope: Column, magic: bytes, key: bytes) -> Column:
    """The magic is there and the mac is that of what follows it. Cheap checks come first, in a CASE."""
    n = F.octet_length(envelope)
    head = F.substring(envelope, 1, len(magic)) == F.lit(magic)
    mac = F.lower(F.hex(F.substring(envelope, MAC_AT + 1, 32)))
    body = F.substring(envelope, IV_AT + 1, n)
    return F.when(envelope.isNull() | (n < HEADER + 16), F.lit(False)).when(~head, F.lit(False)).otherwise(hmac_sha256(key, body) == mac)


def decrypted(envelope: Column, key: bytes) -> Column:
    """Plaintext, or null. The outer layer opens the session (data iv and key), the inner one the ciphertext."""
    outer = F.substring(envelope, IV_AT + 1, 80)  # iv and session block stand side by side
    session = F.try_aes_decrypt(outer, F.lit(key), F.lit("CBC"), F.lit("PKCS"))
    body = F.concat(F.substring(session, 1, 16), F.substring(envelope, HEADER + 1, F.octet_length(envelope)))
    return F.try_aes_decrypt(body, F.substring(session, 17, 32), F.lit("CBC"), F.lit("PKCS"))


def blob_id(content: Column, salt: bytes = b"") -> Column:
    """Hexadecimal SHA-256 of salt and bytes."""
    return F.sha2(F.concat(F.lit(salt), content) if salt else content, 256)


def verifier(spark: SparkSession, magic: bytes, key: bytes):
    """X1 with a real key: an Arrow function (binary -> boolean)."""
    import pandas as pd

    sent = spark.sparkContext.broadcast((magic, key))

    @F.pandas_udf("boolean")
    def ok(envelopes: pd.Series) -> pd.Series:
        magic, key = sent.value

        def one(e):
            return e is not None and len(e) >= HEADER + 16 and e[: len(magic)] == magic and hmac.compare_digest(hmac.new(key, e[IV_AT:], hashlib.sha256).digest(), e[MAC_AT:IV_AT])

        return envelopes.map(one).astype(bool)

    return ok


def lz4_decode(data: bytes) -> bytes:
    """A raw LZ4 block behind its 4-byte big-endian length, by Arrow's codec. Raises ValueError on anything malformed.

    A block expands 255 times at most, so a larger length is refused before it is made room for.
    """
    import pyarrow as pa

    want = int.from_bytes(data[:4], "big")
    if len(data) < 5 or want > 255 * len(data):
        raise ValueError("no length, or one beyond what the block can hold")
    if not want:
        return _lz4_by_sequence(data[4:], want)
    codec = pa.Codec("lz4_raw")
    try:
        out = codec.decompress(data[4:], decompressed_size=want, asbytes=True)
    except OSError:  # cut, malformed, or a block that ends with a copy, which the codec refuses
        return _lz4_by_sequence(data[4:], want)
    try:  # the codec doesn't say how much it made: a block that also fits into less is shorter
        codec.decompress(data[4:], decompressed_size=want - 1)
    except OSError:
        return out
    return _lz4_by_sequence(data[4:], want)


def _lz4_by_sequence(block: bytes, want: int) -> bytes:
    """A block sequence by sequence: literals, then a copy of what was made."""
    out, rest = bytearray(), iter(block)
    try:
        for token in rest:
            sizes = [token >> 4, token & 15]
            for k in (0, 1):
                if sizes[k] == 15:
                    while (more := next(rest)) == 255:
                        sizes[k] += 255
                    sizes[k] += more
                if k == 0:
                    out += bytes(next(rest) for _ in range(sizes[0]))
                    low = next(rest, None)
                    if low is None:  # the last sequence may be literals only
                        break
                    back = low | next(rest) << 8
                    if not 0 < back <= len(out):
                        raise ValueError("a copy from before the start")
                else:
                    n = sizes[1] + 4
                    if len(out) + n > want:
                        raise ValueError("length differs")
                    out += (out[-back:] * (n // back + 1))[:n]
    except (StopIteration, RuntimeError) as e:
        raise ValueError("cut off") from e
    if len(out) != want:
        raise ValueError("length differs")
    return bytes(out)


def decompress(data: bytes | None, code: int | None) -> bytes | None:
    """Bytes by compression code; a null code is LZ4, 0 means none, an unknown code is an error."""
    if data is None:
        return None
    code = LZ4 if code is None else code
    if code == NONE:
        return data
    if code == GZIP:
        return gzip.decompress(data)
    if code == LZ4:
        return lz4_decode(data)
    raise ValueError(f"unknown compression {code}")


def decompressed():
    """X4, X5 as an Arrow function (binary, int) -> struct<data, error>; a bad row is a row with an error."""
    import pandas as pd

    @F.pandas_udf("data binary, error string")
    def f(data: pd.Series, code: pd.Series) -> pd.DataFrame:
        out = []
        for d, c in zip(data, code):
            try:
                out.append((decompress(d, None if pd.isna(c) else int(c)), None))
            except (ValueError, OSError, EOFError) as e:
                out.append((None, str(e)))
        return pd.DataFrame(out, columns=["data", "error"])

    return f


def first_difference():
    """Offset of the first byte that differs, null if none does."""
    import numpy as np
    import pandas as pd

    @F.pandas_udf("long")
    def f(a: pd.Series, b: pd.Series) -> pd.Series:
        def one(x, y):
            n = min(len(x), len(y))
            differ = np.flatnonzero(np.frombuffer(x, np.uint8, n) != np.frombuffer(y, np.uint8, n)) if n else ()
            return int(differ[0]) if len(differ) else None if len(x) == len(y) else n

        return pd.Series([None if x is None or y is None else one(x, y) for x, y in zip(a, b)], dtype="Int64")

    return f
