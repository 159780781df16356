"""Reading tables, running SQL, and sources that may be absent."""

from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from tollwatch import schemas as S


def read_table(spark, source, schema=None):
    """A catalog table by name, or parquet by path with a given schema."""
    if "/" not in source:
        return spark.table(source)
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(source)


def register_warehouse(spark, locations):
    """Register warehouse tables as views: table name -> catalog name or path."""
    for name, source in locations.items():
        read_table(spark, source, S.WAREHOUSE_TABLES[name]).createOrReplaceTempView(name)


def run_query(spark, sql, args=None):
    """Run SQL text; values go in as bound parameters ``:name``, never into the text."""
    return spark.sql(sql, args=args or {})


def read_like(spark, path, like):
    """Parquet with only the columns of another frame."""
    return spark.read.parquet(path).select(*like.columns)


def read_if_exists(spark, path, schema):
    """Parquet at ``path``, or an empty frame of ``schema`` where there is none.

    Only absence counts; any other failure is raised.
    """
    found = read_or_none(spark, path, schema)
    return spark.createDataFrame([], schema) if found is None else found


def read_or_none(spark, path, schema=None):
    try:
        reader = spark.read if schema is None else spark.read.schema(schema)
        return reader.parquet(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


# How the log separates records and names fields.
RECORD_END = ",]"
LOG_FIELDS = ["account_sid", "country", "mcc", "mnc", "date", "error_code", "result",
              "category", "reason"]


def read_response_log(spark, path):
    """Records of a triage log; a log of one single line still splits into many tasks.

    A value is a bracketed list, a quoted text or a bare word, kept as it
    stands apart from its quotes. Every record that is not blank is kept;
    fields that it lacks are null.
    """
    records = spark.read.text(path, lineSep=RECORD_END).where(F.col("value").rlike(r"\S"))
    return records.select(*[_log_field(name) for name in LOG_FIELDS])


def _log_field(name):
    value = F.regexp_extract(
        "value", rf"\b{name}=(\[[^\]]*\]|'[^']*'|\"[^\"]*\"|[^ ,]+)", 1)
    bare = F.regexp_replace(value, r"^['\"]|['\"]$", "")
    return F.when(value != "", bare).alias(name)
