"""Canonical JSON and the identities that are hashes of it, as column expressions.

Payloads are given as name -> column; keys are put in code-point order, as canonical JSON wants
them. Integers stay integers, nulls are kept, and doubles are refused by the query: their text is not stable.
Characters are escaped as Python's json does it, with lower-case digits.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SURROGATES = 0x10000


def _hex4(n: Column) -> Column:
    return F.concat(F.lit("\\u"), F.lpad(F.lower(F.hex(n.cast("long"))), 4, "0"))


def _escaped(ch: Column) -> Column:
    code = F.ascii(ch)
    high = F.lit(0xD800) + F.shiftright(code - _SURROGATES, 10)
    low = F.lit(0xDC00) + F.pmod(code - _SURROGATES, F.lit(0x400))
    return F.when(code < 0x7F, ch).when(code < _SURROGATES, _hex4(code)).otherwise(F.concat(_hex4(high), _hex4(low)))


def _with(value: Column, f) -> Column:
    """f(value), where value is evaluated once however often f names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def ascii_only(json: Column) -> Column:
    r"""JSON text with every character beyond ASCII, and DEL, as \uXXXX; other text is passed on as it is."""
    return _with(json, _ascii)


def _ascii(json: Column) -> Column:
    chars = F.transform(F.sequence(F.lit(1), F.length(json)), lambda i: F.substring(json, i, F.lit(1)))
    return F.when(json.rlike(r"[^\x00-\x7e]"), F.array_join(F.transform(chars, _escaped), "")).otherwise(json)


def _lower_escapes(json: Column) -> Column:
    r"""\u000B as \u000b, and so on; a backslash that is itself escaped begins no escape."""
    out = json
    for digit in "ABCDEF":
        out = F.regexp_replace(out, rf"(?<!\\)((?:\\\\)*)\\u00([01]){digit}", rf"$1\\u00$2{digit.lower()}")
    return F.when(json.rlike(r"\\u00[01][A-F]"), out).otherwise(json)


def _stable(c: Column) -> Column:
    """c, unless its type holds doubles, which fails the query; the check is folded when it is planned."""
    return F.when(F.typeof(c).rlike(r"\b(double|float)\b"), F.raise_error(F.lit("doubles have no canonical text"))).otherwise(c)


def canonical_json(payload: Mapping[str, Column], ascii: bool = True) -> Column:
    """Compact JSON of payload with sorted keys and kept nulls; ascii escapes other characters."""
    fields = [_stable(payload[k]).alias(k) for k in sorted(payload)]
    text = _with(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}), _lower_escapes)
    return ascii_only(text) if ascii else text


def content_id(prefix: str, payload: Mapping[str, Column]) -> Column:
    """prefix:sha256:<64 hex> of the canonical payload."""
    return F.concat(F.lit(f"{prefix}:sha256:"), F.sha2(canonical_json(payload), 256))


def stable_id(prefix: str, payload: Mapping[str, Column]) -> Column:
    """prefix-<first 32 hex> of the canonical payload's sha256."""
    return F.concat(F.lit(f"{prefix}-"), F.substring(F.sha2(canonical_json(payload), 256), 1, 32))


def variant_id(schema_version: str, assembly: Column, contig: Column, start: Column, end: Column, ref: Column, alt: Column) -> Column:
    """Identity of an allele that is normalized already; texts are trimmed, case counts."""
    return content_id("variant", {
        "identity_schema_version": F.lit(schema_version),
        "assembly": F.trim(assembly),
        "contig": F.trim(contig),
        "normalized_start_0based": start.cast("long"),
        "normalized_end_0based": end.cast("long"),
        "normalized_ref": F.trim(ref),
        "normalized_alt": F.trim(alt),
    })


def link_id(event: Column, variant: Column, run: Column, schema_version: str, status: str, method: str, method_version: str) -> Column:
    return content_id("event-variant-link", {
        "schema_version": F.lit(schema_version),
        "event_id": event,
        "variant_id": variant,
        "benchmark_run_id": run,
        "identity_status": F.lit(status),
        "identity_method": F.lit(method),
        "identity_method_version": F.lit(method_version),
    })


def candidate_id(prefix: str, run_a: Column, event_a: Column, run_b: Column, event_b: Column, basis: Column, status: Column) -> Column:
    """Identity of an unordered candidate pair whose runs are given in order."""
    return content_id(prefix, {"event_id_a": event_a, "event_id_b": event_b, "benchmark_run_id_a": run_a, "benchmark_run_id_b": run_b, "candidate_basis": basis, "identity_status": status})


def selection_hash(salt: str, identity: Column) -> Column:
    """Hash that orders a selection: sha256 of the salt, a bar and the identity."""
    return F.sha2(F.concat(F.lit(f"{salt}|"), identity), 256)


def shard_key(identity: Column, digits: int = 2) -> Column:
    return F.substring(F.sha2(identity, 256), 1, digits)


def parameter_hash(payload: Mapping[str, Column]) -> Column:
    """sha256 of UTF-8 JSON followed by a line end; characters beyond ASCII stay."""
    return F.sha2(F.concat(canonical_json(payload, ascii=False), F.lit("\n")), 256)


def artifact_token(uri: Column) -> Column:
    return F.substring(F.sha2(uri, 256), 1, 16)


def row_json(df: DataFrame, ascii: bool = True) -> Column:
    return canonical_json({c: F.col(c) for c in df.columns}, ascii)


def table_hash(df: DataFrame, *order: str) -> str:
    """sha256 of the canonical JSON array of a bounded table's rows in a total order.

    The rows pass the driver one at a time, in order; nothing is collected.
    """
    import hashlib

    digest, first = hashlib.sha256(b"["), True
    for (text,) in df.orderBy(*order).select(row_json(df)).toLocalIterator():
        digest.update(text.encode() if first else b"," + text.encode())
        first = False
    digest.update(b"]")
    return digest.hexdigest()


def table_fingerprint(df: DataFrame) -> DataFrame:
    """n_rows and an order-free checksum of all rows, for tables of any size."""
    h = F.conv(F.substring(F.sha2(row_json(df), 256), 1, 15), 16, 10).cast("decimal(38,0)")
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.coalesce(F.sum(h), F.lit(0)).cast("string").alias("checksum"))
