"""Row filters. An argument left as None filters nothing."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tollwatch.functions.columns import all_of, as_date, as_timestamp, joined_key
from tollwatch.operators.lists import splittable


def account_is(account_sid):
    return None if account_sid is None else F.col("account_sid") == account_sid


def account_like(pattern):
    """LIKE on the account: ``%`` and ``_`` are wildcards."""
    return None if pattern is None else F.col("account_sid").like(pattern)


def mcc_is(mcc):
    return None if mcc is None else F.col("mcc") == mcc


def product_is(product):
    return None if product is None else F.col("product_id") == product


def within_days(days, as_of=None, column="data_load_date"):
    """The last ``days`` calendar days including ``as_of``; no upper bound.

    The column itself stays bare so that the bound reaches the scan and prunes
    date partitions.
    """
    if days is None:
        return None
    return F.col(column) > F.date_sub(as_date(as_of), int(days))


def in_range(start, end, column="data_load_date"):
    """Both ends included."""
    return F.col(column).between(as_date(start), as_date(end))


def loaded_since(since, column="data_load_date"):
    """Strictly after ``since``."""
    return None if since is None else F.col(column) > as_date(since)


def not_expired(as_of=None, column="expiry_time"):
    """Expiry strictly after ``as_of``."""
    return F.col(column) > as_timestamp(as_of)


def keep(df, *conditions):
    return df.where(all_of(*conditions))


def exclusion_override(df, config):
    """Set ``block`` to ``No`` on excluded rows; other rows are left as they are.

    ``config["do_not_include"]`` holds up to three lists: ``mcc``, ``mcc_mnc``
    and ``mcc_mnc_account``, parts joined by ``_``. A list may also be a frame
    whose first column holds the entries; long lists should be, since they are
    joined and not written into the plan. A hot key of the rows is split by
    adaptive execution. ``do_not_include`` may also be one frame of (level, key).
    """
    lists = config.get("do_not_include") or {}
    if isinstance(lists, DataFrame):
        one = lists
        lists = {level: one.where(F.col("level") == level).select("key")
                 for level in ("mcc", "mcc_mnc", "mcc_mnc_account")}
    columns = df.columns
    keys = {
        "mcc": F.col("mcc"),
        "mcc_mnc": joined_key("mcc", "mnc"),
        "mcc_mnc_account": joined_key("mcc", "mnc", "account_sid"),
    }
    hit = None
    for name, key in keys.items():
        listed = lists.get(name)
        if isinstance(listed, DataFrame):
            # no entry is null, so a null key finds none
            entries = listed.select(listed[listed.columns[0]].alias(f"_{name}")).dropna().distinct()
            df = df.withColumn("_key", key).join(entries, splittable("_key", f"_{name}"), "left")
            found = F.col(f"_{name}").isNotNull()
        elif listed:
            found = key.isin(list(listed))
        else:
            continue
        hit = found if hit is None else hit | found
    if hit is None:
        return df
    return df.select(*[F.when(hit, "No").otherwise(F.col("block")).alias("block")
                       if c == "block" else c for c in columns])
