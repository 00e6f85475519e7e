"""Canonical texts and SHA-256 digests of nested values.

Text form: fields by name, nulls written, doubles with exactly six decimals,
timestamps as microseconds. Values under credential-like keys are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ballast.functions.vocab import SENSITIVE_FRAGMENTS

REDACTED = "[REDACTED]"
_SENSITIVE = "(?i)(" + "|".join(SENSITIVE_FRAGMENTS) + ")"


def _quoted(text: Column) -> Column:
    escaped = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    return F.concat(F.lit('"'), escaped, F.lit('"'))


def is_sensitive(name: str) -> bool:
    return any(f in name.lower() for f in SENSITIVE_FRAGMENTS)


def canonical(value: Column, kind: T.DataType) -> Column:
    """Canonical text of ``value``, whose type is ``kind``."""
    if isinstance(kind, T.StructType):
        parts: list[Column] = []
        for f in sorted(kind.fields, key=lambda f: f.name):
            inner = F.lit(f'"{REDACTED}"') if is_sensitive(f.name) else canonical(value[f.name], f.dataType)
            parts.append(F.concat(F.lit(f'"{f.name}":'), inner))
        text = F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))
    elif isinstance(kind, T.ArrayType):
        text = F.concat(
            F.lit("["), F.concat_ws(",", F.transform(value, lambda x: canonical(x, kind.elementType))), F.lit("]")
        )
    elif isinstance(kind, T.MapType):
        def pair(e):
            inner = F.when(e["key"].rlike(_SENSITIVE), F.lit(f'"{REDACTED}"')).otherwise(
                canonical(e["value"], kind.valueType)
            )
            return F.concat(_quoted(e["key"]), F.lit(":"), inner)

        by_key = F.array_sort(F.map_keys(value))
        entries = F.transform(by_key, lambda k: F.struct(k.alias("key"), value[k].alias("value")))
        text = F.concat(F.lit("{"), F.concat_ws(",", F.transform(entries, pair)), F.lit("}"))
    elif isinstance(kind, (T.DoubleType, T.FloatType)):
        text = value.cast("double").cast("decimal(38,6)").cast("string")
    elif isinstance(kind, T.TimestampType):
        text = F.unix_micros(value).cast("string")
    elif isinstance(kind, T.StringType):
        text = _quoted(value)
    else:
        text = value.cast("string")
    return F.coalesce(text, F.lit("null"))


def digest_of(df: DataFrame, columns: list[str]) -> Column:
    """Digest of the named columns of ``df`` taken as one object."""
    kind = T.StructType([df.schema[c] for c in columns])
    return F.sha2(canonical(F.struct(*columns), kind), 256)


def group_digest(df: DataFrame, keys: list[str], row_digest: str, out: str, prefix: int = 5) -> DataFrame:
    """Order-free digest of each group's row digests.

    Rows are first digested per leading ``prefix`` hex digits, then those digests
    per group, so that no task gathers a group: at most 16**prefix short texts
    meet at the top.
    """
    joined = lambda c: F.sha2(F.concat_ws("", F.array_sort(F.collect_list(c))), 256)
    leaf = (
        df.groupBy(*keys, F.substring(row_digest, 1, prefix).alias("_p"))
        .agg(joined(row_digest).alias("_d"), F.count(F.lit(1)).alias("_n"))
    )
    return leaf.groupBy(*keys).agg(joined("_d").alias(out), F.sum("_n").alias(f"{out}_rows"))


def manifest_digest(rows: DataFrame, header: list[str], out: str, left_out: tuple[str, ...] = ()) -> DataFrame:
    """Digest of each manifest: its header fields and every field of its rows, in whatever order these come.

    A manifest's own digest and remarks are named in ``left_out``. Rows carry their
    place as a field, so the digest tells one order of the train from another.
    """
    fields = [c for c in rows.columns if c not in (*header, *left_out)]
    tree = group_digest(rows.withColumn("_row", digest_of(rows, fields)), header, "_row", "_tree")
    head = [canonical(F.col(c), rows.schema[c].dataType) for c in header]
    return tree.select(*header, F.sha2(F.concat_ws("|", *head, F.col("_tree_rows").cast("string"), "_tree"), 256).alias(out))
