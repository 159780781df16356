"""Column expressions shared by the operators; all run inside the JVM."""

from pyspark.sql import Column, functions as F

RUN_TIME_FORMAT = "yyyy-MM-dd_HH_mm"
EXPIRY_FORMAT = "yyyy-MM-dd HH:mm:ss"


def col(c):
    return c if isinstance(c, Column) else F.col(c)


def as_date(day=None):
    """Date column from a column, date or text; today when not given."""
    if day is None:
        return F.current_date()
    return day if isinstance(day, Column) else F.lit(day).cast("date")


def as_timestamp(moment=None):
    """Timestamp column from a column, datetime or text; now when not given."""
    if moment is None:
        return F.current_timestamp()
    return moment if isinstance(moment, Column) else F.lit(moment).cast("timestamp")


def all_of(*conditions):
    """AND of the given conditions; true when there is none."""
    result = None
    for condition in conditions:
        if condition is not None:
            result = condition if result is None else result & condition
    return F.lit(True) if result is None else result


def json_fields(c, *names):
    """Top-level JSON fields as a struct of text, read in one parse.

    Absent and null fields are null; unreadable JSON gives only nulls.
    """
    return F.from_json(col(c), ", ".join(f"{name} string" for name in names))


def flag(c):
    """Text as boolean, null where it is none."""
    return col(c).try_cast("boolean")


def joined_key(*parts, sep="_"):
    """Parts joined by ``sep``; null when any part is null."""
    pieces = []
    for part in parts:
        if pieces:
            pieces.append(F.lit(sep))
        pieces.append(col(part).cast("string"))
    return F.concat(*pieces)


def hashed(c, function="sha256_hex"):
    """Hex digest; sha256 also for no name, null for a name not known."""
    function = function or "sha256_hex"
    if function == "sha256_hex":
        return F.sha2(col(c), 256)
    if function == "md5_hex":
        return F.md5(col(c))
    return F.lit(None).cast("string")


def allow_key(phone, hash_keys):
    """Allow-list key of a phone number; the hashed form covers the leading plus."""
    number = col(phone).cast("string")
    if hash_keys:
        number = hashed(F.concat(F.lit("+"), number))
    return F.concat(F.lit("allow_"), number)


def ttl_seconds(expiry, record):
    """Whole seconds from record to expiry."""
    micros = F.unix_micros(col(expiry)) - F.unix_micros(col(record))
    return F.floor(micros / 1_000_000).cast("long")


def title_label(c):
    return F.initcap(F.replace(col(c), F.lit("_"), F.lit(" ")))


def not_blank(c):
    return F.trim(col(c)) != ""


def nulls_last(c):
    """Ordering value that puts nulls after everything else."""
    return F.struct(col(c).isNull().alias("absent"), col(c).alias("value"))
