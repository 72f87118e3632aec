"""Deterministic records: values drawn from the SHA-256 of a JSON list, so that every engine draws the same."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

STAMP = "2026-02-22T12:00:00"


def json_text(c: Column) -> Column:
    """A JSON string literal with \\uXXXX for what is not ASCII."""
    plain = F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    for raw, escape in (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        plain = F.replace(plain, F.lit(raw), F.lit(escape))

    def one(ch: Column) -> Column:
        code = F.ascii(ch)
        hex4 = lambda n: F.concat(F.lit("\\u"), F.lpad(F.lower(F.hex(n)), 4, "0"))
        return F.when((code >= 32) & (code < 127), ch).when(code < 65536, hex4(code)).otherwise(F.concat(hex4(F.lit(0xD800) + F.floor((code - 65536) / 1024)), hex4(F.lit(0xDC00) + (code - 65536) % 1024)))

    spelled = F.when(plain.rlike(r"[^\x20-\x7e]"), F.array_join(F.transform(F.filter(F.split(plain, ""), lambda x: x != ""), one), "")).otherwise(plain)
    return F.concat(F.lit('"'), spelled, F.lit('"'))


def payload(seed: str, *args: Column | int) -> Column:
    parts = [F.lit(str(a)) if isinstance(a, int) else json_text(a.cast("string")) for a in args]
    return F.concat(F.lit(f'["{seed}"'), *[x for p in parts for x in (F.lit(", "), p)], F.lit("]"))


def hashed(seed: str, *args: Column | int) -> Column:
    return F.sha2(payload(seed, *args), 256)


def remainder(hex_digest: Column, n: int) -> Column:
    """The 256-bit number modulo n (below 2**31), 32 bits at a time."""
    out = F.lit(0).cast("long")
    for k in range(8):
        out = (out * ((1 << 32) % n) + F.conv(F.substring(hex_digest, 8 * k + 1, 8), 16, 10).cast("long")) % n
    return out


def pick(hex_digest: Column, values: list) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), remainder(hex_digest, len(values)).cast("int"))


def identifier(prefix: str, seed: str, *args: Column) -> Column:
    return F.concat(F.lit(f"{prefix}_"), F.substring(hashed(seed, *args), 1, 12))


def keyed_identifier(prefix: str, **args: Column) -> Column:
    """Of [prefix, {name: value}], names in order."""
    body = [x for i, k in enumerate(sorted(args)) for x in (F.lit((", " if i else "") + f'"{k}": '), json_text(args[k].cast("string")))]
    return F.concat(F.lit(f"{prefix}_"), F.substring(F.sha2(F.concat(F.lit(f'["{prefix}", {{'), *body, F.lit("}]")), 256), 1, 12))
