"""Results for other programs: strict JSON lines keyed by source, rows without what JSON can't hold, and lineage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType, MapType, StructType


def finite(df: DataFrame) -> DataFrame:
    """df with infinite and undefined numbers as null, wherever they stand, and empty maps as null."""

    def bad(kind) -> bool:
        if isinstance(kind, (ArrayType, MapType)):
            return isinstance(kind, MapType) or bad(kind.elementType)
        return any(bad(f.dataType) for f in kind.fields) if isinstance(kind, StructType) else isinstance(kind, (DoubleType, FloatType))

    def plain(x: Column, kind) -> Column:
        if isinstance(kind, (DoubleType, FloatType)):
            return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)
        if not bad(kind):
            return x
        if isinstance(kind, ArrayType):
            return F.transform(x, lambda v: plain(v, kind.elementType))
        if isinstance(kind, MapType):
            inner = F.transform_values(x, lambda _, v: plain(v, kind.valueType)) if bad(kind.valueType) else x
            return F.when(F.size(x) > 0, inner)
        return F.when(x.isNotNull(), F.struct(*(plain(x.getField(f.name), f.dataType).alias(f.name) for f in kind.fields)))

    return df.select(*(plain(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields))


def sidecar(results: DataFrame) -> DataFrame:
    """value: a JSON record for each case (source_id, case_id and more), keyed by source_id, else by case_id."""
    rest = [c for c in results.columns if c not in ("source_id", "case_id")]
    keyed = finite(results).select(F.lit("sidecar/1").alias("schema_version"), "source_id", "case_id", F.coalesce("source_id", "case_id").alias("key"), *rest)
    return keyed.select(F.to_json(F.struct(*keyed.columns), {"ignoreNullFields": "false"}).alias("value"))


def write_sidecar(results: DataFrame, path: str) -> None:
    sidecar(results).write.mode("overwrite").text(path)


def provenance(df: DataFrame, path: str, inputs: list[str]) -> None:
    """One JSON row beside an output: its inputs, its columns and an order-free digest of its rows."""
    digest = df.agg(F.count(F.lit(1)).alias("rows"), F.sum(F.xxhash64(F.to_json(F.struct(*df.columns))).cast("decimal(38,0)")).cast("string").alias("digest"))
    digest.select(F.array(*map(F.lit, inputs)).alias("inputs"), F.array(*map(F.lit, df.columns)).alias("columns"), "rows", "digest").write.mode("overwrite").json(path)
