"""JSON lines in and out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from quarry.schema import Field, Schema


def _value(raw: Column, f: Field) -> Column:
    """A field's JSON text to its value; null if the type doesn't fit."""
    kind = {"text": "string", "u64": "bigint", "i64": "bigint", "f64": "double", "json": "string", "bytes": "string"}.get(f.kind)
    text = F.when(raw.startswith('"'), F.from_json(F.concat(F.lit('{"v":'), raw, F.lit("}")), "v string")["v"])
    if f.kind == "text":
        return text
    if f.kind == "json":
        return raw
    if f.kind == "bytes":
        return F.try_to_binary(text, F.lit("base64"))
    if kind:
        number = F.when(raw.rlike(r"^-?[0-9]+$") if kind == "bigint" else raw.rlike(r"^-?[0-9.]+([eE][-+]?[0-9]+)?$"), raw.try_cast(kind))
        return F.when(number >= 0, number) if f.kind == "u64" else number
    if f.kind == "dense_vector":
        return F.from_json(raw, "array<float>")
    if f.kind == "binary_dense_vector":
        return F.from_json(raw, "array<bigint>")
    pair = F.from_json(raw, "indices array<int>, values array<float>")
    return F.arrays_zip(pair["indices"].alias("dim"), pair["values"].alias("weight"))


def parse_documents(lines: DataFrame, schema: Schema, column: str = "value") -> DataFrame:
    """(a column for each field, error): documents from JSON texts.

    Unknown keys are not looked at, and a value of the wrong type is null. For a field of
    several values one value counts as an array of one; for another, the first of an array
    counts. Blank lines are left out; error tells what is wrong with a line, its fields are null
    then. A content hash of the wrong type is an error.
    """
    rows = lines.filter(F.trim(column) != "").withColumn("__m", F.from_json(column, "map<string,string>", {"mode": "PERMISSIVE"}))
    good = F.col("__m").isNotNull() & F.trim(column).startswith("{")
    out, errors = [], [F.when(~good, F.lit("not a JSON object"))]
    for f in schema.fields:
        # get_json_object() keeps a value's JSON text for arrays and objects; strings come quoted from to_json.
        raw = F.get_json_object(column, f"$.{f.name}")
        whole = F.from_json(column, T.StructType([T.StructField(f.name, T.VariantType())]))[f.name]
        as_json = F.when(whole.isNotNull(), F.to_json(whole))
        vector = f.kind in ("dense_vector", "binary_dense_vector", "sparse_vector")
        if vector:
            value = F.when(F.lit(f.multi), None).otherwise(_value(raw, f))
            if f.multi:
                value = F.transform(F.from_json(as_json, "array<string>"), lambda x: _value(x, f))
        else:
            items = F.when(as_json.startswith("["), F.transform(F.variant_get(whole, "$", "array<variant>"), lambda v: F.to_json(v))).when(as_json.isNotNull(), F.array(as_json))
            values = F.filter(F.transform(items, lambda x: _value(x, f)), lambda v: v.isNotNull())
            value = F.when(F.size(values) > 0, values) if f.multi else F.get(values, 0)
        out.append(F.when(good, value).cast(f.spark_type()).alias(f.name))
        if f.content_hash:
            errors.append(F.when(good & as_json.isNotNull() & value.isNull(), F.lit(f"bad {f.name}")))
    return rows.select(*out, F.coalesce(*errors).alias("error"))


def read_documents(spark: SparkSession, path: str, schema: Schema) -> DataFrame:
    return parse_documents(spark.read.text(path), schema)


def to_json(docs: DataFrame, schema: Schema) -> DataFrame:
    """(value): each document's stored fields as JSON; nulls are left out."""
    stored = [f.name for f in schema.fields if f.stored]
    return docs.select(F.to_json(F.struct(*stored)).alias("value"))


def write_shards(records: DataFrame, path: str, shard: str = "shard") -> None:
    """Records as JSON lines, in a folder for each shard."""
    records.repartition(shard).write.partitionBy(shard).json(path)
