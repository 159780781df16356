"""Reports composed of several operators."""

from pyspark.sql import functions as F

from tollwatch.functions import text as X
from tollwatch.operators import accounts, blocks, tickets, traffic


def account_report(tables, days=30, as_of=None, since=None, account_pattern=None):
    """Everything on the account page, for all accounts at once, as named frames."""
    history = accounts.service_history(tables["service_events"], account_pattern)
    services = accounts.latest_service(history)
    daily = traffic.account_daily_traffic(
        traffic.daily_traffic(tables["traffic_features"], days, as_of))
    daily_blocks = blocks.daily_blocks(tables["raw_events"], days=days, as_of=as_of)
    return {
        "status": accounts.account_status(
            accounts.latest_flags(tables["account_features"], since)),
        "service_history": history,
        "service_count": accounts.service_count(history),
        "services_by_status": accounts.by_status(services),
        "daily_traffic": daily,
        "daily_blocks": daily_blocks,
        "traffic_series": traffic.traffic_series(daily),
        "block_series": blocks.block_series(daily_blocks),
    }


def triage_report(rows):
    """All triage outputs side by side, one row per ticket, in one narrow stage.

    The issue is categorised twice: from the text and from its summary. The
    products found are decoded, and account, product and issue are restated.
    """
    found = tickets.ticket_fields(rows)
    found = tickets.ticket_products(found)
    found = found.withColumn("decoded_products", X.decode_products("products"))
    found = tickets.ticket_categories(found)
    found = tickets.ticket_summary(found)
    found = tickets.ticket_categories(
        found, "summary", "summary_categories", X.SUMMARY_PHRASES)
    found = tickets.account_id_check(found)
    found = found.withColumn("_issue", F.array_join(F.col("categories"), ", "))
    found = tickets.issue_details(found, category="_issue", reason="summary").drop("_issue")
    return tickets.ticket_reply(found)
