"""Reading plan tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from specval import config as C
from specval.session import materialize
from specval.sources.arrays import read_json_values

DEFAULT_PATH = "data/processed/latest_processed_data.csv"


@dataclass
class Batch:
    """Plans with one set of options; ``rejects`` holds what could not be read (``record``, ``reason``)."""

    rows: DataFrame
    options: dict
    rejects: DataFrame


def _typed(text: Column, kind: T.DataType) -> Column:
    """A value given as number, text or flag in the declared type; what doesn't fit is missing. Fractions of whole numbers are cut off."""
    if isinstance(kind, T.StringType):
        return text
    number = text.try_cast("double")
    if isinstance(kind, T.BooleanType):
        return F.coalesce(text.try_cast("boolean"), number != 0)
    if isinstance(kind, T.IntegralType):
        return F.coalesce(text.try_cast(kind), number.try_cast(kind))
    return number.try_cast(kind)


def parse_records(raw: DataFrame, schema: T.StructType = C.PLAN_SCHEMA) -> DataFrame:
    """JSON texts (``value``) to plans: the fields of ``schema``, ``extra`` (a map with all other fields), ``options``, and for what could not
    be read ``record`` with a ``reason``.

    A text is a plan, a list of plans, or an envelope ``{options, data}``, whose options go with its own plans only.
    """
    text, plan = F.trim("value"), "map<string,string>"
    whole = F.from_json(text, plan, {"mode": "PERMISSIVE"})
    is_list = text.startswith("[")
    keyed = raw.filter(F.length(text) > 0).select(
        F.col("value").alias("record"), is_list.alias("is_list"), F.when(~is_list, whole).alias("one"), F.when(is_list, text).alias("list"))
    envelope = F.map_contains_key("one", F.lit("data"))
    listed = F.from_json(F.when(envelope, F.col("one")["data"]).otherwise(F.col("list")), f"array<{plan}>")
    plans = F.when(F.coalesce(envelope, F.lit(False)) | F.col("is_list"), listed).otherwise(F.array("one"))
    given = F.from_json(F.when(F.coalesce(envelope, F.lit(False)), F.col("one")["options"]), plan)
    opened = keyed.select("record", given.alias("given"), F.posexplode_outer(
        F.when(F.size(plans) == 0, F.array(F.create_map().cast(plan))).otherwise(plans)).alias("place", "p"))
    names = [f.name for f in schema.fields]
    known = F.arrays_overlap(F.map_keys("p"), F.array(*[F.lit(n) for n in names]))
    reason = F.when(F.col("p").isNull(), "no plans in it").when((F.size("p") > 0) & ~known, "not a plan")
    options = F.struct(*[
        F.coalesce(_typed(F.col("given")[f.name], f.dataType), F.lit(C.DEFAULT_OPTIONS.get(f.name)).cast(f.dataType)).alias(f.name) for f in C.OPTIONS_SCHEMA.fields])
    parsed = opened.filter("p IS NULL OR size(p) > 0").select(
        *[_typed(F.col("p")[f.name], f.dataType).alias(f.name) for f in schema.fields],
        F.map_filter("p", lambda k, _: ~k.isin(names)).alias("extra"), options.alias("options"), reason.alias("reason"),
        F.when(reason.isNotNull(), F.col("record")).alias("record"))
    return parsed


def read_batches(spark: SparkSession, path: str, lines: bool = True, schema: T.StructType = C.PLAN_SCHEMA) -> list[Batch]:
    """A1: one batch per set of options. ``lines`` reads one JSON value per line, which splits large files over tasks; without it
    every file is one value, and the objects of a long array are read by many tasks.

    The source is read once; the parsed plans are a written table that everything later reads.
    """
    raw = spark.read.text(path) if lines else read_json_values(spark, path)
    parsed = materialize(parse_records(raw, schema), "plan-batch")
    rejects = parsed.filter("reason IS NOT NULL").select("record", "reason")
    rows = parsed.filter("reason IS NULL").drop("record", "reason")
    sets = rows.select("options").distinct().collect()  # one batch each
    if not sets:
        raise ValueError("No data to process" if rejects.isEmpty() else "Expected a list of plan data")
    batches = []
    for r in sorted(sets, key=str):
        match = F.lit(True)
        for k, v in r["options"].asDict().items():
            match = match & F.col(f"options.{k}").eqNullSafe(F.lit(v))
        batches.append(Batch(rows.filter(match).drop("options"), r["options"].asDict(), rejects))
    return batches


def read_batch(spark: SparkSession, path: str, lines: bool = True, schema: T.StructType = C.PLAN_SCHEMA) -> Batch:
    """A1 where all plans have the same options."""
    batches = read_batches(spark, path, lines, schema)
    if len(batches) > 1:
        raise ValueError(f"{len(batches)} different sets of options; read_batches keeps them apart")
    return batches[0]


def expand_variants(items: DataFrame, base_id: str = "base", keys: list[str] | None = None) -> DataFrame:
    """Every variant with the base features it does not change itself.

    ``items`` has id, name, features and changed_features (maps). The base is a single row and becomes literals of the
    plan. Without a base the items' own features are returned. The result has a column per feature; ``keys`` names them
    without a scan, ``variant_maps`` keeps them in a map.
    """
    base = _base_features(items, base_id)
    full = items.select("id", "name", _changes().alias("m"))
    if keys is None:
        seen = full.select(F.explode(F.map_keys("m")).alias("k")).distinct().collect()  # as many as the result has columns
        keys = sorted({*base, *(r["k"] for r in seen)})
    return full.select("id", "name", *[
        F.when(F.map_contains_key("m", k), F.col("m").getItem(k)).otherwise(F.lit(base.get(k)).cast("double")).alias(k) for k in keys
    ])


def _base_features(items: DataFrame, base_id: str) -> dict[str, float]:
    row = items.filter(F.col("id") == base_id).select("features").limit(1).collect()
    return (row[0]["features"] or {}) if row else {}


def _changes():
    return F.coalesce("features", "changed_features", F.create_map().cast("map<string,double>"))


def variant_maps(items: DataFrame, base_id: str = "base") -> DataFrame:
    """A2 for any number of features: ``features`` is the base's map with the item's own entries on top."""
    base = F.create_map(*[F.lit(x) for pair in _base_features(items, base_id).items() for x in pair]).cast("map<string,double>")
    kept = F.map_filter(base, lambda k, _: ~F.map_contains_key("m", k))
    return items.select("id", "name", _changes().alias("m")).select("id", "name", F.map_concat(kept, "m").alias("features"))


def read_scenarios(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    schema = "id string, name string, features map<string,double>, changed_features map<string,double>"
    items = spark.read.schema(schema).option("multiLine", not lines).json(path)
    return normalise_types(expand_variants(items))


def normalise_types(df: DataFrame) -> DataFrame:
    """A3."""
    df = df.withColumns({
        c: F.coalesce(F.col(c).try_cast("boolean"), F.lit(False)).cast("int") for c in C.LOAD_BOOL_COLUMNS if c in df.columns
    })
    df = df.withColumns({c: F.col(c).try_cast("double") for c in C.LOAD_NUMERIC_COLUMNS if c in df.columns})
    return df.na.fill(0, [c for c in C.LOAD_ZERO_FILL_COLUMNS if c in df.columns])


def fill_missing(df: DataFrame) -> DataFrame:
    """Every missing value becomes 0, in text columns the text '0'."""
    df = df.na.fill(0).na.fill("0")
    booleans = [c for c, t in df.dtypes if t == "boolean"]
    return df.na.fill(False, booleans) if booleans else df


def missing_columns(df: DataFrame) -> DataFrame:
    """Which columns have missing values, and how many."""
    row = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    return row.unpivot([], df.columns, "column_name", "missing").filter("missing > 0")


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """A4. Without ``schema`` the types are inferred, which reads the file twice."""
    reader = spark.read.option("header", True)
    df = (reader.schema(schema) if schema is not None else reader.option("inferSchema", True)).csv(path)
    return fill_missing(df)


def looks_processed(df: DataFrame) -> bool:
    return any(c in df.columns for c in C.PROCESSED_MARKER_COLUMNS)


def load(spark: SparkSession, path: str = DEFAULT_PATH, **options) -> DataFrame:
    """A5: by file extension; unknown extensions are an error."""
    name = path.rstrip("/").lower()
    if name.endswith(".json"):
        return read_scenarios(spark, path, **options)
    if name.endswith(".csv"):
        return read_csv(spark, path, **options)
    if name.endswith(".parquet"):
        return spark.read.parquet(path)
    raise ValueError(f"Unsupported file format for {path}. Use CSV, JSON or Parquet.")


def load_default(spark: SparkSession) -> DataFrame:
    return load(spark)
