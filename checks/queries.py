"""One check query per operator: ``(spark, sf_dir) -> DataFrame``."""

from functools import wraps

from pyspark.sql import functions as F, types as T

from checks.views import Data
from tollwatch import schemas as S
from tollwatch.functions import columns as C, text as X
from tollwatch.operators import (
    accounts, blocks, filters, items, lists, scoring, state, tickets, traffic,
)
from tollwatch.plans import publish, reports
from tollwatch.session import fresh_path
from tollwatch.sources import sinks, tables, versions
from tollwatch.streaming import daily, upsert

AS_OF = "2024-01-30"
START, END = "2024-01-05", "2024-01-20"
SINCE = "2024-01-02"
NOW = "2024-01-29 00:00:00"
MID = "2024-01-16 00:00:00"
ACCOUNT, MCC = "AC000004", "204"
EXCLUDED = {"do_not_include": {
    "mcc": ["201"], "mcc_mnc": ["202_01", "203_02"], "mcc_mnc_account": ["206_00_AC000006"]}}
SYSTEM_TEXT = "Extract the account id, codes and dates from the query."

QUERIES = {}


def shown(df):
    """Dates, times and arrays as text and doubles rounded, so that hashes compare."""
    def show(field):
        c, kind = F.col(field.name), field.dataType
        if isinstance(kind, T.DateType):
            return F.date_format(c, "yyyy-MM-dd").alias(field.name)
        if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
            return F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(field.name)
        if isinstance(kind, T.ArrayType):
            return F.array_join(c, "|").alias(field.name)
        if isinstance(kind, T.DoubleType):
            return F.round(c, 9).alias(field.name)
        return c
    return df.select(*[show(f) for f in df.schema.fields])


def query(build):
    """Register under the function's name; ``build`` gets the derived views."""
    @wraps(build)
    def run(spark, sf_dir):
        return shown(build(Data(spark, sf_dir)))
    QUERIES[build.__name__] = run
    return run


# Sources and sinks

@query
def scan_tables(d):
    counts = None
    for name in S.WAREHOUSE_TABLES:
        getattr(d, name)
        one = tables.read_table(d.spark, name).groupBy("account_sid").agg(
            F.count(F.lit(1)).alias("n_rows")).withColumn("table_name", F.lit(name))
        counts = one if counts is None else counts.union(one)
    return counts.select("table_name", "account_sid", "n_rows")


@query
def run_query(d):
    d.raw_events
    return tables.run_query(
        d.spark,
        "select account_sid, count(*) as n from raw_events"
        " where product_id = :product and data_load_date > date(:since) group by account_sid",
        {"product": S.VERIFY, "since": SINCE})


@query
def scan_projected(d):
    like = d.events.select("event_id", "event_type", "value")
    return tables.read_like(d.spark, f"{d.sf_dir}/events.parquet", like)


@query
def append_sink(d):
    path = fresh_path(d.spark, "append")
    sinks.append_rows(d.state_rows, path, update=False)
    sinks.append_rows(d.new_rows.withColumn("note", F.lit("new")), path)
    return sinks.read_appended(d.spark, path)


@query
def overwrite_state_sink(d):
    path = fresh_path(d.spark, "state")
    versions.overwrite_state(d.state_rows, path)
    versions.overwrite_state(
        state.union_by_name(versions.read_version(d.spark, path), d.new_rows), path)
    return versions.read_version(d.spark, path)


@query
def run_snapshot_sink(d):
    path = fresh_path(d.spark, "snapshots")
    sinks.run_snapshot(d.master_old, path, "account_sid", "2024-01-15 08:05:00")
    sinks.run_snapshot(d.master_new, path, "amm", "2024-01-16 08:05:00")
    sinks.run_snapshot(d.master_new, path, "other", "2024-01-16 09:05:00")
    return d.spark.read.parquet(path).withColumn("run_date", F.col("run_date").cast("string"))


@query
def archive_layout(d):
    base = fresh_path(d.spark, "archive")
    rows = d.state_rows
    written = sinks.archive(base, "breach", {"state": d.new_rows, "current": rows}, NOW)
    written += sinks.archive(base, "flooding", {"current": d.new_rows}, NOW)
    written += sinks.archive(base, "phones", {
        "phones": d.candidates.select("account_sid", "mcc", "mnc", "record_time"),
        "prefixes": rows, "allow_list": d.new_rows}, NOW)
    counts = None
    for kind in written:
        one = d.spark.read.parquet(f"{base}/{kind}").groupBy("kind", "run_date").agg(
            F.count(F.lit(1)).alias("n_rows"))
        counts = one if counts is None else counts.union(one)
    return counts.withColumn("run_date", F.col("run_date").cast("string"))


@query
def optional_source(d):
    absent = tables.read_if_exists(d.spark, fresh_path(d.spark, "absent"), S.SKIPLIST)
    path = fresh_path(d.spark, "skiplist")
    d.skiplist.write.parquet(path)
    present = tables.read_if_exists(d.spark, path, S.SKIPLIST)
    return absent.withColumn("source", F.lit("absent")).union(
        present.withColumn("source", F.lit("present")))


@query
def response_log_scan(d):
    path = fresh_path(d.spark, "log")
    d.response_log.select("value").write.text(path)
    return tables.read_response_log(d.spark, path)


# Filters

@query
def filter_account(d):
    return filters.keep(d.traffic_features, filters.account_is(ACCOUNT))


@query
def filter_account_like(d):
    return filters.keep(d.traffic_features, filters.account_like("AC0000_2%"))


@query
def filter_lookback(d):
    return filters.keep(d.traffic_features, filters.within_days(15, AS_OF))


@query
def filter_date_range(d):
    return filters.keep(d.traffic_features, filters.in_range(START, END))


@query
def filter_product(d):
    return filters.keep(d.raw_events, filters.product_is(S.MESSAGING))


@query
def filter_mcc(d):
    return filters.keep(d.traffic_features, filters.mcc_is(MCC))


@query
def filter_since(d):
    return filters.keep(d.account_features, filters.loaded_since(SINCE))


@query
def exclusion_override(d):
    return filters.exclusion_override(
        d.candidates.select("event_id", "account_sid", "mcc", "mnc", "block"), EXCLUDED)


@query
def exclusion_override_lists(d):
    """All keys of the state as a long list, two codes as a short one."""
    listed = d.state_rows.select(F.lit("mcc_mnc_account").alias("level"), F.concat_ws(
        "_", "mcc", "mnc", "account_sid").alias("key")).union(
        d.state_rows.where("mcc in ('201', '203')").select(F.lit("mcc"), "mcc"))
    rows = d.candidates.select("event_id", "account_sid", "mcc", "mnc", "block")
    return filters.exclusion_override(rows, {"do_not_include": listed})


@query
def expired_filter(d):
    return filters.keep(d.state_rows, filters.not_expired(MID))


@query
def account_status(d):
    return accounts.account_status(accounts.latest_flags(d.account_features, SINCE))


@query
def is_account_present(d):
    return accounts.account_present(d.account_features, d.raw_events, "2024-01-28")


# Joins

@query
def join_friendly_name(d):
    return lists.join_friendly_name(d.traffic_features, d.account_names)


@query
def skiplist_anti(d):
    rows = d.candidates.select("event_id", "account_sid", "phone_prefix")
    return lists.skiplist_anti(rows, d.skiplist)


@query
def cleared_anti(d):
    return state.cleared(d.state_rows, d.cleared_keys)


@query
def delta_outer(d):
    return state.rows_not_in(d.master_new, d.master_old)


@query
def prefix_merge(d):
    return lists.prefix_merge(d.candidates, "higher_prefix")


def _block_list(d, prefilter):
    blocked = lists.prefix_keys(d.candidates.where("block = 'Yes'"))
    higher = lists.prefix_keys(
        d.candidates.where("higher_prefix_block_flag = 'Yes'"), "higher_prefix",
        "higher_prefix_record_time", "higher_prefix_expiry_time")
    rows = d.candidates.select("event_id", "phone_prefix", "higher_prefix", "mnc", "mode")
    return lists.check_block_list(rows, blocked.unionByName(higher), prefilter)


@query
def block_list_check(d):
    return _block_list(d, False)


@query
def block_list_check_filtered(d):
    return _block_list(d, True)


@query
def allow_list_check(d):
    allowed = lists.allow_list_build(d.candidates.where("mcc = '203'"), hash_keys=True)
    rows = d.candidates.select("event_id", "phone_number")
    return lists.check_allow_list(rows, allowed, hash_keys=True)


@query
def delete_keys(d):
    held = lists.prefix_keys(d.candidates)
    return lists.delete_keys(held, d.skiplist, "prefix")


# Aggregations

@query
def traffic_daily_verify(d):
    return traffic.daily_traffic(d.traffic_features, 30, AS_OF)


@query
def traffic_daily_verify_mcc(d):
    return traffic.daily_traffic(d.traffic_features, 30, AS_OF, mcc=MCC)


@query
def traffic_daily_msg(d):
    return traffic.daily_traffic(d.message_traffic_features, 30, AS_OF)


@query
def traffic_daily_msg_mcc(d):
    return traffic.daily_traffic(d.message_traffic_features, 30, AS_OF, mcc=MCC)


@query
def traffic_daily_one_account(d):
    return traffic.daily_traffic(d.traffic_features, 30, AS_OF, account_sid=ACCOUNT)


@query
def block_breakdown_verify(d):
    return blocks.block_breakdown(d.raw_events, S.VERIFY, as_of=AS_OF)


@query
def block_breakdown_verify_mcc(d):
    return blocks.block_breakdown(d.raw_events, S.VERIFY, as_of=AS_OF, mcc=MCC)


@query
def block_breakdown_msg(d):
    return blocks.block_breakdown(d.raw_events, S.MESSAGING, as_of=AS_OF)


@query
def block_breakdown_msg_mcc(d):
    return blocks.block_breakdown(d.raw_events, S.MESSAGING, as_of=AS_OF, mcc=MCC)


@query
def daily_metrics_fg(d):
    return blocks.daily_metrics_verify(d.raw_events, 30, AS_OF)


@query
def daily_metrics_spp(d):
    return blocks.daily_metrics_messaging(d.raw_events, 30, AS_OF)


@query
def range_totals_verify(d):
    return blocks.range_totals(d.raw_events, START, END, S.TOTALS_VERIFY, S.VERIFY)


@query
def range_totals_flooding(d):
    return blocks.range_totals(d.raw_events, START, END, S.TOTALS_FLOODING, S.MESSAGING)


@query
def range_totals_risk(d):
    return blocks.range_totals(d.raw_events, START, END, S.TOTALS_RISK)


@query
def range_summary_verify(d):
    return blocks.range_summary(d.raw_events, START, END, S.SUMMARY_VERIFY, S.VERIFY)


@query
def range_summary_msg(d):
    return blocks.range_summary(d.raw_events, START, END, S.SUMMARY_MESSAGING, S.MESSAGING)


def _report(d):
    return reports.account_report(
        {name: getattr(d, name) for name in S.WAREHOUSE_TABLES}, 30, AS_OF, SINCE)


def _daily_traffic(d):
    return traffic.account_daily_traffic(traffic.daily_traffic(d.traffic_features, 30, AS_OF))


def _daily_blocks(d):
    return blocks.daily_blocks(d.raw_events, as_of=AS_OF)


@query
def account_daily_traffic(d):
    return _daily_traffic(d)


@query
def account_daily_blocks(d):
    return _daily_blocks(d)


@query
def account_daily_blocks_rollup(d):
    return blocks.account_daily_blocks(blocks.block_breakdown(d.raw_events, as_of=AS_OF))


@query
def block_reports(d):
    return blocks.block_reports(d.raw_events, as_of=AS_OF)


@query
def service_count(d):
    return accounts.service_count(d.service_events)


@query
def traffic_by_code(d):
    return traffic.traffic_by_code(traffic.daily_traffic(d.traffic_features, 30, AS_OF))


# Ordered groups and deduplication

@query
def mode_change(d):
    return accounts.mode_change(accounts.service_settings(d.service_events))


@query
def rank_by_update(d):
    return accounts.rank_by_update(
        d.service_events.select("account_sid", "service_sid", "updated_at"))


@query
def latest_flags(d):
    return accounts.latest_flags(d.account_features, SINCE)


@query
def service_history(d):
    return accounts.service_history(d.service_events)


@query
def service_history_like(d):
    return accounts.service_history(d.service_events, "AC0000_2%")


@query
def distinct_rows(d):
    return accounts.service_settings(d.service_events).drop("friendly_name")


@query
def latest_service(d):
    return accounts.latest_service(accounts.service_settings(d.service_events))


@query
def split_by_status(d):
    return accounts.by_status(
        accounts.latest_service(accounts.service_settings(d.service_events)))


@query
def dedupe_latest_expiry(d):
    return state.dedupe_latest_expiry(d.state_rows)


@query
def dedupe_key(d):
    return state.dedupe_key(d.master_old, ["account_sid"])


@query
def dedupe_prefix(d):
    rows = d.candidates.select("higher_prefix", "mcc", "mnc", "record_time", "expiry_time")
    return state.dedupe_prefix(rows, "higher_prefix")


# Order

@query
def history_newest_first(d):
    return accounts.newest_first(accounts.service_history(d.service_events))


@query
def order_by_ordinal(d):
    return blocks.daily_metrics_verify(d.raw_events, 30, AS_OF, product=S.VERIFY)


@query
def latest_one(d):
    return accounts.latest_flags(d.account_features, account_sid=ACCOUNT)


@query
def state_sort(d):
    return state.sort_by_expiry(d.state_rows)


# Set operations and state

@query
def union_all_by_name(d):
    left = d.state_rows.select("account_sid", "mcc", "record_time")
    right = d.new_rows.select("expiry_time", "mcc", "account_sid")
    return state.union_by_name(left, right)


@query
def delta_rows(d):
    return state.delta_rows(d.master_new, d.master_old, "account_sid")


@query
def master_merge(d):
    return state.master_merge(d.master_new, d.master_old, "account_sid")


@query
def master_merge_new(d):
    return state.master_merge(d.master_new, d.master_old, "account_sid", prefer="new")


@query
def merge_and_publish(d):
    paths = [fresh_path(d.spark, name) for name in ("store", "snapshots")]
    publish.merge_and_publish(d.master_old, d.master_old, *paths, "account_sid",
                              reset=True, run_at=MID)
    master, delta = publish.merge_and_publish(
        d.master_new, d.master_new, *paths, "account_sid", run_at=NOW)
    return master.withColumn("output", F.lit("master")).union(
        delta.withColumn("output", F.lit("delta")))


@query
def state_upsert(d):
    return state.state_upsert(d.state_rows, d.new_rows, d.cleared_keys, NOW)


@query
def state_update_run(d):
    path = fresh_path(d.spark, "breach")
    publish.update_state(path, d.state_rows, d.cleared_keys)
    return publish.update_state(path, d.new_rows, d.cleared_keys, update=True, as_of=NOW)


def _amm(rows):
    return rows.withColumn("key", C.joined_key("account_sid", "mcc", "mnc", sep="-"))


@query
def insert_if_absent_ttl(d):
    held = lists.last_write(_amm(d.state_rows)).select("key", "record_time", "expiry_time")
    return lists.insert_if_absent_ttl(held, _amm(d.new_rows), MID)


@query
def upsert_ttl_keys(d):
    split = F.lit(MID).cast("timestamp")
    held = lists.prefix_keys(d.candidates.where(F.col("record_time") < split))
    new = lists.prefix_keys(d.candidates.where(F.col("record_time") >= split))
    return lists.with_value(lists.upsert_ttl_keys(held, new, NOW))


@query
def account_prefix_keys(d):
    return lists.account_prefix_keys(d.candidates)


@query
def allow_list_build(d):
    return lists.with_value(lists.allow_list_build(d.candidates, hash_keys=True))


@query
def allow_list_build_plain(d):
    return lists.allow_list_build(d.candidates)


@query
def account_items(d):
    return items.account_items(d.account_settings)


@query
def threshold_items(d):
    return items.threshold_items(d.threshold_rows)


@query
def hash_columns(d):
    return d.candidates.select(
        "event_id", C.hashed("account_sid").alias("sha"),
        C.hashed("account_sid", "md5_hex").alias("md5"),
        C.hashed("account_sid", "other").alias("unknown"),
        C.hashed("phone_number", None).alias("phone_sha"))


# Ticket triage

@query
def ticket_fields(d):
    return tickets.ticket_fields(d.tickets).drop("conv_id", "turn", "role", "text")


@query
def ticket_products(d):
    return tickets.ticket_products(d.tickets).select("ticket_id", "products")


@query
def ticket_categories(d):
    return tickets.ticket_categories(d.tickets).select("ticket_id", "categories")


@query
def decode_products(d):
    found = tickets.ticket_products(tickets.ticket_fields(d.tickets))
    answers = F.concat("products", "error_code", F.array(F.lit("none of these")))
    return found.select("ticket_id", X.decode_products(answers).alias("decoded"))


@query
def decode_issue(d):
    found = tickets.ticket_categories(d.tickets)
    return found.select(
        "ticket_id", X.decode_issue("text").alias("of_text"),
        X.decode_issue(F.array_join("categories", " ")).alias("of_categories"),
        X.decode_issue("role").alias("of_role"))


@query
def account_id_check(d):
    checked = tickets.account_id_check(tickets.ticket_fields(d.tickets))
    return checked.select("ticket_id", "account_sid", "is_account_id", "is_full_account_id")


@query
def parse_responses(d):
    return tickets.accepted(tickets.parse_responses(d.responses, S.ISSUE_RECORD))


@query
def parse_rejects(d):
    return tickets.rejected(tickets.parse_responses(d.responses, S.ISSUE_RECORD))


@query
def ticket_reply(d):
    found = tickets.ticket_categories(tickets.ticket_fields(d.tickets))
    return tickets.ticket_reply(found).select("ticket_id", "reply")


@query
def issue_details(d):
    parsed = tickets.parse_responses(d.tickets.join(d.responses, "ticket_id"), S.ISSUE_RECORD)
    found = tickets.ticket_products(tickets.ticket_fields(parsed)).withColumn(
        "label", F.when(F.size("category") > 0, X.decode_issue(F.array_join("category", " "))))
    return tickets.issue_details(found, category="label").select("ticket_id", "details")


@query
def block_series_long(d):
    return blocks.block_series(_daily_blocks(d))


@query
def traffic_series(d):
    return traffic.traffic_series(_daily_traffic(d))


@query
def transcript(d):
    return tickets.transcript(d.conversations)


@query
def transcript_lines(d):
    return tickets.transcript_lines(d.conversations)


@query
def route_messages(d):
    return tickets.route_messages(d.messages).select("conv_id", "turn", "route")


@query
def triage_report(d):
    return reports.triage_report(d.tickets).drop("conv_id", "turn", "role", "text")


@query
def ticket_summary(d):
    found = tickets.ticket_categories(tickets.ticket_products(tickets.ticket_fields(d.tickets)))
    return tickets.ticket_summary(found).select("ticket_id", "summary")


@query
def account_page(d):
    report = _report(d)
    return report["status"].join(report["service_count"], "account_sid", "left")


# Streams

def _event_stream(d):
    # A glob, since the table may be one file or a folder of files.
    path = f"{d.sf_dir}/event[s].parquet"
    events = d.spark.readStream.schema(d.events.schema).parquet(path)
    return Data(d.spark, d.sf_dir, events=events)


@query
def stream_daily_metrics(d):
    path, checkpoint = (fresh_path(d.spark, n) for n in ("daily", "daily-checkpoint"))
    stream = _event_stream(d).raw_events
    daily.start_daily_metrics(stream, path, checkpoint).awaitTermination()
    return versions.read_version(d.spark, path)


@query
def stream_state_upsert(d):
    path, checkpoint = (fresh_path(d.spark, n) for n in ("upsert", "upsert-checkpoint"))
    versions.overwrite_state(d.state_rows, path)
    cleared = d.cleared_keys.select("*")
    stream = _event_stream(d).new_rows
    upsert.start_upsert(stream, path, checkpoint, upsert.upserting(lambda batch: cleared, NOW),
                        S.STATE).awaitTermination()
    return versions.read_version(d.spark, path)


# Model hooks, with stand-in models

def _stand_in(name):
    return lambda prompts: name + ":" + prompts.str.len().astype(str)


@query
def render_prompts(d):
    prompts = tickets.render_prompts(d.tickets, SYSTEM_TEXT)
    return prompts.select("ticket_id", "system_prompt", "user_prompt")


@query
def score_batch(d):
    prompts = tickets.render_prompts(d.tickets, SYSTEM_TEXT).select("ticket_id", "user_prompt")
    return scoring.score_batch(prompts, _stand_in("model")).drop("user_prompt")


@query
def score_new(d):
    """A first run over some tickets, then one over all, which asks only for the rest."""
    prompts = tickets.render_prompts(d.tickets, SYSTEM_TEXT).select("ticket_id", "user_prompt")
    store = fresh_path(d.spark, "answers")
    for rows in (prompts.where(F.length("user_prompt") > 60), prompts):
        found = scoring.score_new(rows, _stand_in("model"), store, "model-1")
    return found.drop("user_prompt")


@query
def ticket_categories_lexicon(d):
    """Categories by a lexicon table: the built-in phrases as rows."""
    rows = [(label, k, phrase) for k, (label, phrases) in enumerate(X.CATEGORY_PHRASES.items())
            for phrase in phrases]
    lexicon = d.spark.createDataFrame(rows, "label string, place int, phrase string")
    found = tickets.labels_by_lexicon(d.tickets, lexicon, "categories")
    return found.select("ticket_id", "categories")


@query
def model_compare(d):
    prompts = tickets.render_prompts(d.tickets, SYSTEM_TEXT).select("ticket_id", "user_prompt")
    models = {name: _stand_in(name) for name in ("model_a", "model_b", "model_c")}
    return scoring.model_compare(prompts, models).drop("user_prompt")
