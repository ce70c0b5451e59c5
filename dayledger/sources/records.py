"""The record table of moderation statements: CSV ingest, typing, quarantine."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dayledger.functions.text import empty_to_null, group_lists, parse_list
from dayledger.operators.checks import canonical
from dayledger.operators.spec import CountsWith, Dataset, Duration, ListStats, NullPattern, Rows, TextCounts, TextRows, ValueCounts

#: Columns in their order, by kind (text, list, time).
FIELDS = {
    "uuid": "text", "decision_visibility": "list", "decision_visibility_other": "text", "end_date_visibility_restriction": "time",
    "decision_monetary": "text", "decision_monetary_other": "text", "end_date_monetary_restriction": "time",
    "decision_provision": "text", "end_date_service_restriction": "time", "decision_account": "text", "end_date_account_restriction": "time",
    "account_type": "text", "decision_ground": "text", "decision_ground_reference_url": "text",
    "illegal_content_legal_ground": "text", "illegal_content_explanation": "text",
    "incompatible_content_ground": "text", "incompatible_content_explanation": "text", "incompatible_content_illegal": "text",
    "category": "text", "category_addition": "list", "category_specification": "list", "category_specification_other": "text",
    "content_type": "list", "content_type_other": "text", "content_language": "text", "content_date": "time", "content_id_ean": "text",
    "territorial_scope": "list", "application_date": "time", "decision_facts": "text",
    "source_type": "text", "source_identity": "text", "automated_detection": "text", "automated_decision": "text",
    "platform_name": "text", "platform_uid": "text", "created_at": "time",
}
_TYPES = {"text": T.StringType(), "list": T.ArrayType(T.StringType()), "time": T.TimestampType()}
SCHEMA = T.StructType([T.StructField(c, _TYPES[k]) for c, k in FIELDS.items()] + [T.StructField("released_on", T.DateType())])
#: Lists that stay empty rather than null.
KEEP_EMPTY = ("category_addition",)
TIME_FORMAT = "yyyy-MM-dd HH:mm:ss"

#: Member states; the larger groups add to them.
EU = "AT BE BG CY CZ DE DK EE ES FI FR GR HR HU IE IT LT LU LV MT NL PL PT RO SE SI SK".split()
TERRITORIES = {"EU": EU, "EEA": sorted([*EU, "IS", "LI", "NO"]), "EEA_no_IS": sorted([*EU, "LI", "NO"])}

_ENDS = {"visibility": "visibility", "monetary": "monetary", "provision": "service", "account": "account"}
#: What the profile computes for these records.
PROFILE = Dataset(
    specs=(
        Rows(),
        NullPattern("decision_type", tuple(f"decision_{d}" for d in _ENDS), ("vis", "mon", "pro", "acc")),
        *[CountsWith(f"decision_{d}", f"end_date_{e}_restriction", is_list=d == "visibility") for d, e in _ENDS.items()],
        *[Duration(f"{e}_restriction_duration", "application_date", f"end_date_{e}_restriction") for e in _ENDS.values()],
        Duration("moderation_delay", "content_date", "application_date"),
        Duration("disclosure_delay", "application_date", "created_at"),
        *[ValueCounts(c) for c in ("account_type", "decision_ground", "incompatible_content_illegal", "content_language", "source_type", "automated_detection", "automated_decision")],
        *[TextCounts(c) for c in ("decision_visibility_other", "decision_monetary_other", "decision_ground_reference_url", "category_specification_other", "content_type_other", "source_identity")],
        *[TextRows(c) for c in ("illegal_content_legal_ground", "illegal_content_explanation", "incompatible_content_ground", "incompatible_content_explanation", "content_id_ean", "decision_facts")],
        *[ListStats(c) for c in ("category_addition", "category_specification", "content_type", "territorial_scope")],
    ),
    day="released_on",
    platform="platform_name",
)

_CORRUPT = "_corrupt_record"


def read_csv(spark: SparkSession, *paths: str, columns: list[str] | None = None) -> DataFrame:
    """Batches as text, one column per field, with the file's name and rows that don't parse in _corrupt_record.

    Quotes are doubled inside quoted fields, which may hold newlines. columns names the
    fields of the files; older ones lack content_id_ean. "" and [] are null.
    """
    names = columns or list(FIELDS)
    schema = T.StructType([T.StructField(c, T.StringType()) for c in [*names, _CORRUPT]])
    df = spark.read.schema(schema).csv(list(paths), header=True, multiLine=True, quote='"', escape='"', mode="PERMISSIVE", columnNameOfCorruptRecord=_CORRUPT, enforceSchema=True)
    text = [F.nullif(F.nullif(F.col(c), F.lit("")), F.lit("[]")).alias(c) for c in names]
    return df.select(*text, _CORRUPT, F.col("_metadata.file_path").alias("file"))


def write_csv(rows: DataFrame, path: str, most: int = 100_000) -> None:
    """Text rows as read_csv() has them, in compressed files of at most ``most`` rows, the size of the source's own batches.

    A file whose fields hold newlines is read by one task from end to end.
    """
    rows.write.option("header", True).option("quote", '"').option("escape", '"').option("compression", "gzip").option("maxRecordsPerFile", most).csv(path)


def batch_path(root: str, release: date | str, index: int | None = None, name: str = "sor-global") -> str:
    """The pattern of the files of a release, or of one batch of it: name-release-full-index-part.csv."""
    return f"{root.rstrip('/')}/{name}-{release}-full-{'*' if index is None else f'{index:05d}'}-*.csv"


def read_batch(spark: SparkSession, root: str, release: date | str, index: int | None = None, **options) -> DataFrame:
    """The batches of a release, or one of them by its index, as read_csv() has them."""
    return read_csv(spark, batch_path(root, release, index), **options)


def read_all_versions(spark: SparkSession, old: list[str], new: list[str]) -> DataFrame:
    """Files without and with content_id_ean as one table; the older have null there."""
    without = [c for c in FIELDS if c != "content_id_ean"]
    parts = [read_csv(spark, *paths, columns=names) for paths, names in ((old, without), (new, None)) if paths]
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1], allowMissingColumns=True)


def _typed(c: str, kind: str) -> Column:
    if kind == "time":
        return F.try_to_timestamp(F.col(c), F.lit(TIME_FORMAT)).alias(c)
    if kind == "list":
        items = parse_list(group_lists(F.col(c), TERRITORIES) if c == "territorial_scope" else F.col(c))
        return (items if c in KEEP_EMPTY else empty_to_null(items)).alias(c)
    return F.col(c)


def reasons(df: DataFrame, domains: dict[str, list[str]] | None = None) -> Column:
    """Why a text row can't be typed: a row that doesn't parse, bad timestamps, values outside their domain."""
    found = [F.when(F.col(_CORRUPT).isNotNull(), F.lit("malformed row"))]
    found += [F.when(F.col(c).isNotNull() & F.try_to_timestamp(F.col(c), F.lit(TIME_FORMAT)).isNull(), F.lit(f"{c}: not a time")) for c, k in FIELDS.items() if k == "time" and c in df.columns]
    for c, allowed in (domains or {}).items():
        outside = F.size(F.array_except(parse_list(F.col(c)), F.array(*[F.lit(a) for a in allowed]))) > 0 if FIELDS[c] == "list" else ~F.col(c).isin(allowed)
        found.append(F.when(F.col(c).isNotNull() & outside, F.lit(f"{c}: unknown value")))
    return F.array_compact(F.array(*found))


def ingest(raw: DataFrame, released_on: date | Column, aliases: DataFrame | None = None, domains: dict[str, list[str]] | None = None) -> tuple[DataFrame, DataFrame]:
    """(records, quarantine): typed rows of the fixed schema, and text rows with the reasons they aren't."""
    checked = raw.withColumn("reasons", reasons(raw, domains))
    if "content_id_ean" not in raw.columns:
        checked = checked.withColumn("content_id_ean", F.lit(None).cast("string"))
    good = checked.where(F.size("reasons") == 0)
    good = canonical(good, "platform_name", aliases) if aliases is not None else good
    day = released_on if isinstance(released_on, Column) else F.lit(released_on)
    return good.select(*[_typed(c, k) for c, k in FIELDS.items()], day.cast("date").alias("released_on")), checked.where(F.size("reasons") > 0)


def day_of_file(column: str = "file") -> Column:
    """The release date in a file's name."""
    return F.to_date(F.regexp_extract(column, r"(\d{4}-\d{2}-\d{2})[^/]*$", 1))
