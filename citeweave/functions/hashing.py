"""Stable hashes used for blinded order, fractions and fingerprints."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructType


def blinded_key(seed: int, query_id: Column, chunk_id: Column) -> Column:
    return F.sha2(F.concat_ws(":", F.lit(str(seed)), query_id.cast("string"), chunk_id), 256)


def leading_fraction(digest: Column) -> Column:
    """First eight bytes of a hexadecimal digest as an unsigned integer over 2**64."""
    high = F.conv(F.substring(digest, 1, 16), 16, 10).cast("decimal(20,0)").cast("double")
    return high / F.lit(float(2**64))


def stable_fraction(seed: int, key: Column) -> Column:
    return leading_fraction(F.sha2(F.concat_ws(":", F.lit(str(seed)), key), 256))


def canonical_json(value: Column, kind: DataType) -> Column:
    """JSON text with sorted keys, nulls written out, ", " and ": " between parts."""
    if isinstance(kind, StructType):
        fields = sorted(kind.fields, key=lambda f: f.name)
        parts = [F.concat(F.lit(f'"{f.name}": '), canonical_json(value[f.name], f.dataType)) for f in fields]
        text = F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}"))
    elif isinstance(kind, ArrayType):
        items = F.transform(value, lambda v: canonical_json(v, kind.elementType))
        text = F.concat(F.lit("["), F.array_join(items, ", "), F.lit("]"))
    else:  # a JSON array of one value without its brackets
        text = F.to_json(F.array(value))
        text = F.substring(text, F.lit(2), F.length(text) - 2)
    return F.when(value.isNull(), F.lit("null")).otherwise(text)


def fingerprint(value: Column, kind: StructType) -> Column:
    """SHA-256 over the canonical JSON of a struct, so that a null never takes a neighbour's place."""
    return F.sha2(canonical_json(value, kind), 256)
