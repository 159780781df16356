"""Item payloads for a typed key-value item store, one JSON text per item."""

from pyspark.sql import functions as F


# Fixed values throughout: the names and type letters that the store expects of an item.

def _text(name):
    return F.struct(F.col(name).cast("string").alias("S")).alias(name)


def _number(column, alias):
    return F.struct(column.cast("string").alias("N")).alias(alias)


def _flag(name):
    return F.struct(F.col(name).alias("BOOL")).alias(name)


def _put(*attributes):
    item = F.struct(F.struct(F.struct(*attributes).alias("Item")).alias("PutRequest"))
    return F.to_json(item).alias("item")


def account_items(settings):
    """One put request per account with its six settings."""
    return settings.select("id", _put(
        _text("id"),
        _text("account_category"),
        _number(F.col("block_ttl_mins"), "block_ttl_mins"),
        _number(F.col("lookback_mins"), "lookback_mins"),
        _number(F.col("default_threshold"), "default_threshold"),
        _flag("optout"),
        _flag("observe"),
    ))


def _threshold(model, kind, column):
    value = F.col(column).cast("long")
    return F.struct(F.struct(
        F.struct(F.lit(model).alias("S")).alias("model_name"),
        F.struct(F.lit(kind).alias("S")).alias("model_type"),
        _number(value, "model_value"),
    ).alias("M"))


def threshold_items(rows):
    """One put request per key with two thresholds, values cut to whole numbers."""
    thresholds = F.array(_threshold("account_ucl", "account", "ucl"),
                         _threshold("three_sigma", "statistical", "threshold"))
    return rows.select("id", _put(
        *[_text(c) for c in ("id", "account_category", "ccr_label", "country_code",
                             "mcc", "mnc")],
        _flag("observe"),
        _number(F.col("block_ttl_mins"), "block_ttl_mins"),
        _number(F.col("lookback_mins"), "lookback_mins"),
        F.struct(thresholds.alias("L")).alias("thresholds"),
    ))
