"""Account flags and service-settings history."""

from pyspark.sql import functions as F

from tollwatch import schemas as S
from tollwatch.functions.columns import flag, json_fields
from tollwatch.operators.filters import account_is, account_like, keep, loaded_since
from tollwatch.operators.ordered import dense_rank_within, lag_within

SERVICE = ["account_sid", "service_sid"]
CHANGE, NO_CHANGE = "Change", "No-Change"


def latest_flags(features, since=None, account_sid=None):
    """Newest flags row of every account.

    The greatest row is an aggregate: unlike a window it needs no task to hold
    all rows of an account. Rows of one date are told apart by their flags.
    """
    rows = keep(features, account_is(account_sid), loaded_since(since))
    rest = [c for c in rows.columns if c not in ("account_sid", "data_load_date")]
    newest = F.max(F.struct("data_load_date", *rest)).alias("newest")
    return rows.groupBy("account_sid").agg(newest).select("account_sid", "newest.*")


def account_present(features, accounts, since=None):
    """Every asked account with whether it has any row since a date."""
    asked = accounts.select("account_sid").distinct()
    seen = (keep(features, loaded_since(since)).select("account_sid").distinct()
            .withColumn("_seen", F.lit(True)))
    return asked.join(seen, "account_sid", "left").select(
        "account_sid", F.coalesce("_seen", F.lit(False)).alias("is_present"))


def account_status(flags):
    """Where an account is active and how it is protected, as columns and one text."""
    def on(name):
        return F.coalesce(F.col(name), F.lit(False))

    verify, messaging = on("account_on_verify"), on("account_on_psms")
    active = (
        F.when(verify & messaging, "active on Verify and Messaging")
        .when(verify, "active on Verify only")
        .when(messaging, "active on Messaging only")
        .otherwise("not active")
    )
    protection = (
        F.when(on("spp_enabled"), "enabled")
        .when(on("spp_shadow_enabled"), "enabled in shadow mode")
        .otherwise("not enabled")
    )
    text = F.concat(F.lit("Account "), F.col("account_sid"), F.lit(" is "), active,
                    F.lit("; message protection is "), protection)
    return flags.select("account_sid", active.alias("activity"),
                        protection.alias("protection"), text.alias("status_text"))


def settings_rows(events):
    """Enabled flag and mode read from the JSON column; unreadable is disabled."""
    settings = json_fields("configuration", S.ENABLED_FIELD, S.MODE_FIELD)
    enabled = flag(f"_settings.{S.ENABLED_FIELD}")
    return events.select(*SERVICE, "friendly_name", "updated_at", settings.alias("_settings")) \
        .select(
            *SERVICE, "friendly_name",
            F.when(enabled, "enable").otherwise("disable").alias("fraud_guard"),
            F.col(f"_settings.{S.MODE_FIELD}").alias("fraud_guard_mode"),
            "updated_at",
        )


def service_settings(events, account_pattern=None):
    """Distinct settings rows.

    Distinct goes over the service name too, so a renamed service may show the
    same settings twice. Copies are combined before the shuffle.
    """
    return settings_rows(keep(events, account_like(account_pattern))).distinct()


def mode_change(settings, segment="month"):
    """Flag rows whose mode differs from the row before of the same service.

    A null mode on either side is no change. A service may have any number of
    rows; ``segment`` bounds those that a task sorts at once.
    """
    order = ["updated_at", "fraud_guard_mode", "fraud_guard", "friendly_name"]
    marked = lag_within(settings, SERVICE, order, "fraud_guard_mode", "_previous", segment)
    changed = F.col("_previous") != F.col("fraud_guard_mode")
    return marked.withColumn(
        "mode_change", F.when(changed, CHANGE).otherwise(NO_CHANGE)).drop("_previous")


def rank_by_update(updates, segment="month"):
    """Dense rank of updates per account, newest first."""
    return dense_rank_within(updates, ["account_sid"], "updated_at", "rank_desc", segment)


def service_history(events, account_pattern=None, segment="month"):
    """Settings history of every service with its mode changes."""
    history = mode_change(service_settings(events, account_pattern), segment)
    return history.select(*SERVICE, "fraud_guard", "fraud_guard_mode", "updated_at",
                          "mode_change")


def newest_first(history):
    return history.orderBy(F.desc("updated_at"), *SERVICE)


def latest_service(settings):
    """Newest settings of every service."""
    newest = F.max(F.struct("updated_at", "fraud_guard_mode", "fraud_guard")).alias("newest")
    return settings.groupBy(*SERVICE).agg(newest).select(
        *SERVICE, "newest.fraud_guard", "newest.fraud_guard_mode", "newest.updated_at")


def service_count(settings):
    """Distinct services per account, null not counted."""
    return settings.groupBy("account_sid").agg(
        F.count_distinct("service_sid").alias("service_sid_count"))


def by_status(latest, status=None):
    """Latest services that are enabled or disabled; both when no status is asked."""
    rows = latest if status is None else latest.where(F.col("fraud_guard") == status)
    return rows.where(F.col("fraud_guard").isin("enable", "disable")).select(
        *SERVICE, "fraud_guard", "fraud_guard_mode")
