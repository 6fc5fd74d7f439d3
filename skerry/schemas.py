"""Declared table schemas and the helpers that make a DataFrame conform to one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skerry.functions.cleaning import iso_date, number, whole_number

WEATHER_MEASURES = [
    "temperature", "wind_direction", "wind_speed", "humidity", "precipitation",
    "pressure", "visibility", "cloud_cover", "gust_wind",
]


def _table(*columns: tuple[str, str], required: tuple[str, ...] = ()) -> T.StructType:
    kinds = {
        "str": T.StringType(), "int": T.IntegerType(), "long": T.LongType(), "float": T.DoubleType(),
        "date": T.DateType(), "ts": T.TimestampNTZType(), "bool": T.BooleanType(),
    }
    return T.StructType(
        [T.StructField(name, kinds[kind], name not in required) for name, kind in columns]
    )


def _strings(names: str) -> list[tuple[str, str]]:
    return [(name, "str") for name in names.split()]


# Column names and types below are fixed values: files and tables carry exactly these.
# record_id alone is wider than in the data it mirrors: 32 bits do not number 100 TB of rows.
RING_RECORDS = _table(
    ("record_id", "long"), ("date", "date"), ("time", "float"),
    *_strings("record_type ring_number age_code species_code ringer age"),
    ("wing_length", "int"), ("weight", "float"), ("fat_score", "int"), ("muscle_score", "int"),
    ("brood_patch", "float"), ("moult_score", "float"),
    *_strings("notes scientific_name swedish_name"),
    ("taxon_id", "float"), ("data_source", "str"), ("created_at", "ts"), ("updated_at", "ts"),
    required=("date", "species_code"),
)

SPECIES_METADATA = _table(
    *_strings("species_code scientific_name swedish_name english_name"),
    ("taxon_id", "float"), *_strings("family order_name additional_info"),
    ("created_at", "ts"), ("updated_at", "ts"),
    required=("species_code",),
)

WEATHER = _table(
    ("observation_time", "ts"),
    *[(measure, "float") for measure in WEATHER_MEASURES],
    *[(f"{measure}_quality", "str") for measure in WEATHER_MEASURES],
    ("station_id", "int"), *_strings("station_name data_source"), ("fetched_at", "ts"),
    required=("observation_time",),
)

OBSERVATIONS = _table(
    *_strings("OccurrenceId DatasetName"),
    ("StartDate", "ts"), ("EndDate", "ts"),
    ("DecimalLatitude", "float"), ("DecimalLongitude", "float"),
    ("CoordinateUncertaintyInMeters", "float"),
    *_strings("Municipality County Locality Province"),
    ("DyntaxaTaxonId", "int"),
    *_strings("ScientificName VernacularName OrganismGroup Family Order Class Kingdom "
              "RedlistCategory IndividualCount OrganismQuantity"),
    ("OrganismQuantityInt", "int"),
    *_strings("OrganismQuantityUnit OccurrenceStatus RecordedBy ReportedBy Sex LifeStage "
              "Activity Behavior Biotope OccurrenceRemarks"),
    ("Weight", "int"), ("Length", "int"),
    ("Verified", "bool"), ("UncertainIdentification", "bool"),
    *_strings("VerificationStatus BasisOfRecord"),
    ("DataProviderId", "int"), ("Modified", "ts"), *_strings("Url Projects"),
    ("fetched_at", "ts"),
    required=("OccurrenceId",),
)

RINGER_INFO = _table(
    *_strings("ringer_code full_name email active_years notes"), ("created_at", "ts"),
    required=("ringer_code",),
)


def column(name: str):
    """Reference a top-level column by its exact name, whatever characters it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def add_missing(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Schema evolution: append every declared column ``df`` lacks as a typed null."""
    missing = {
        field.name: F.lit(None).cast(field.dataType)
        for field in schema if field.name not in df.columns
    }
    return df.withColumns(missing) if missing else df


def enforce_schema(df: DataFrame, schema: T.StructType, drop_invalid: bool = True) -> DataFrame:
    """Select exactly the declared columns in order, cast leniently (a bad value becomes null),
    add absent ones as typed nulls and drop rows lacking a required value."""
    full = add_missing(df, schema)
    parsers = {T.DateType(): iso_date, T.DoubleType(): number, T.IntegerType(): whole_number}

    def conform(field: T.StructField):
        is_text = isinstance(full.schema[field.name].dataType, T.StringType)
        parse = parsers.get(field.dataType) if is_text else None
        value = parse(column(field.name)) if parse else column(field.name).try_cast(field.dataType)
        return value.alias(field.name)

    shaped = full.select(*[conform(field) for field in schema])
    required = [f.name for f in schema if not f.nullable]
    return shaped.dropna(subset=required) if drop_invalid and required else shaped


def needs_rebuild(df: DataFrame, key: str) -> bool:
    """True when a stored table predates its key column and has to be recreated."""
    return key not in df.columns


def in_both(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Only the columns that occur in ``df`` and in ``schema``, in the order of ``df``."""
    declared = set(schema.names)
    return df.select(*[column(c) for c in df.columns if c in declared])
