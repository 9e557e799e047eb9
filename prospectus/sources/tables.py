"""Reading the source tables and writing results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from prospectus.sources.schemas import TABLE_NAMES, schema_of


class Tables:
    """The 15 source tables as DataFrames, opened on first use and then kept."""

    prospect: DataFrame
    assignment: DataFrame
    staff: DataFrame
    contact_report: DataFrame
    proposal: DataFrame
    stage: DataFrame
    prospect_entity: DataFrame
    ucdr_prospect_pool: DataFrame
    ucdr_giving: DataFrame
    ucdr_bio: DataFrame
    tms_stage: DataFrame
    tms_unit_code: DataFrame
    tms_office: DataFrame
    tms_proposal_status: DataFrame
    tms_proposal_stage: DataFrame

    def __init__(self, read: Callable[[str], DataFrame]):
        self._read = read

    def __getattr__(self, table: str) -> DataFrame:
        if table not in TABLE_NAMES:
            raise AttributeError(table)
        df = self._read(table)
        setattr(self, table, df)
        return df


def conform(df: DataFrame, table: str, empty_as_null: bool = False) -> DataFrame:
    """Select the declared columns with their declared types; a missing column raises.

    Columns that already have their type stay bare references, so filters on them still reach the scan.
    ``empty_as_null`` is for exports that wrote the source's nulls as empty text.
    """
    actual = {c.lower(): c for c in df.columns}
    missing = [f.name for f in schema_of(table) if f.name not in actual]
    if missing:
        raise ValueError(f"table {table} lacks {', '.join(missing)}")
    columns = []
    for f in schema_of(table):
        column = F.col(f"`{actual[f.name]}`")
        if df.schema[actual[f.name]].dataType != f.dataType:
            column = column.cast(f.dataType)
        if empty_as_null and isinstance(f.dataType, StringType):
            column = F.nullif(column, F.lit(""))
        columns.append(column.alias(f.name))
    return df.select(*columns)


def load_tables(
    spark: SparkSession, root: str, fmt: str = "parquet", empty_as_null: bool = False, **options: str
) -> Tables:
    """Tables stored as ``root/<table>``.

    Self-describing formats (parquet, orc) keep their own types and are conformed; for text formats the declared
    schema is given to the reader, so nothing is inferred.
    """

    def read(table: str) -> DataFrame:
        reader = spark.read.format(fmt).options(**options)
        if fmt in ("csv", "json"):
            reader = reader.schema(schema_of(table))
        return conform(reader.load(f"{root}/{table}"), table, empty_as_null)

    return Tables(read)


def tables_from_catalog(spark: SparkSession, schema: str, empty_as_null: bool = False) -> Tables:
    """Tables registered in the session catalog as ``schema.<table>``."""
    return Tables(lambda table: conform(spark.table(f"{schema}.{table}"), table, empty_as_null))


# Event tables, the date their windows are cut on, and a column with many values that parts the rows of one date.
EVENT_DATES = {
    "contact_report": ("contact_date", "report_id"),
    "ucdr_giving": ("date_of_record", "id_number"),
    "proposal": ("start_date", "proposal_id"),
    "assignment": ("stop_date", "prospect_id"),
    "stage": ("stage_date", "proposal_id"),
}


def write_tables(tables: Tables, root: str, mode: str = "errorifexists") -> None:
    """Store the tables as Parquet, event tables ordered by date.

    Range partitioning by date gives each file a narrow date span, so a window filter skips whole files and row
    groups by their statistics without a partition column in the path. Rows of one date, or without one, are parted by a
    second column and a hash of the row, so a bulk load of a single day still spreads over files.
    """
    for table in TABLE_NAMES:
        _by_date(getattr(tables, table), table).write.mode(mode).parquet(f"{root}/{table}")


def _by_date(df: DataFrame, table: str) -> DataFrame:
    if table not in EVENT_DATES:
        return df
    date, second = EVENT_DATES[table]
    df = df.withColumn("_spread", F.xxhash64(*df.columns))
    return df.repartitionByRange(date, second, "_spread").sortWithinPartitions(date, second).drop("_spread")


# Tables that reports join and count by a key with many values, and that key.
JOIN_KEYS = {
    "prospect": "prospect_id",
    "assignment": "prospect_id",
    "contact_report": "prospect_id",
    "proposal": "prospect_id",
    "stage": "prospect_id",
    "prospect_entity": "prospect_id",
    "ucdr_prospect_pool": "prosp_id",
}


def crowded_bucket(df: DataFrame, key: str, buckets: int, crowd: float, least_rows: int) -> bool:
    """Whether one key (null included) alone has more rows than ``crowd`` even buckets, and more than ``least_rows``."""
    counts = df.groupBy(key).agg(F.count("*").alias("n")).agg(F.sum("n").alias("all"), F.max("n").alias("most")).first()
    return (counts["most"] or 0) > max(least_rows, crowd * (counts["all"] or 0) / buckets)


def write_bucketed(
    tables: Tables,
    schema: str,
    buckets: int,
    mode: str = "errorifexists",
    crowd: float = 4.0,
    least_rows: int = 1_000_000,
) -> list[str]:
    """Store the tables in the catalog as ``schema.<table>``, those with a join key in ``buckets`` buckets of it.

    Joins and counts by the key then need no shuffle; ``tables_from_catalog`` reads them. Inside a bucket event tables
    are ordered by date, so a window filter still skips row groups. For joins by the key and more columns, set
    ``spark.sql.requireAllClusterKeysForCoPartition`` to false.

    A bucket is read by one task, whatever its size. So a table of which one key alone has more rows than ``crowd`` even
    buckets (and than ``least_rows``) is stored in date order instead, as ``write_tables`` does, and its joins shuffle,
    where Spark can split the key. Returns the names of the tables that were bucketed. An empty table is bucketed too.
    """
    bucketed = []
    for table in TABLE_NAMES:
        df = getattr(tables, table)
        key, (date, _) = JOIN_KEYS.get(table), EVENT_DATES.get(table, (None, None))
        if key is None or crowded_bucket(df, key, buckets, crowd, least_rows):
            _by_date(df, table).write.mode(mode).format("parquet").saveAsTable(f"{schema}.{table}")
            continue
        order = [date] if date else [key]
        # dealt like the buckets, so that each is one file
        writer = df.repartition(buckets, key).write.mode(mode).format("parquet").bucketBy(buckets, key).sortBy(*order)
        writer.saveAsTable(f"{schema}.{table}")
        bucketed.append(table)
    return bucketed


def write_report(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists", **options: str) -> None:
    """Write a report where it is, partition by partition."""
    df.write.format(fmt).mode(mode).options(**options).save(path)
