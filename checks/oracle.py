"""DuckDB SQL with the same result as each check query."""

from checks.queries import (
    ACCOUNT, AS_OF, END, EXCLUDED, MCC, MID, NOW, SINCE, START, SYSTEM_TEXT,
)
from checks.views import VIEWS, closure, needs
from tollwatch import schemas as S
from tollwatch.functions import text as X
from tollwatch.operators.tickets import (
    ASK_ACCOUNT, ASK_DETAIL, DETAILS, GENERAL, HELP, REPLIES,
)

ORACLES = {}


def add(name, select, **steps):
    """Register ``select``; ``steps`` are further named queries it reads, in order."""
    texts = [*steps.values(), select]
    views = [v for v in closure([n for text in texts for n in needs(text)]) if v in VIEWS]
    parts = [f"{v} as ({VIEWS[v]})" for v in views]
    parts += [f"{step} as ({sql})" for step, sql in steps.items()]
    ORACLES[name] = (f"with {', '.join(parts)} " if parts else "") + select


def quoted(text):
    return "'" + text.replace("'", "''") + "'"


def day(c="data_load_date"):
    return f"cast({c} as varchar) as {c}"


def moment(*columns):
    return ", ".join(f"strftime({c}, '%Y-%m-%d %H:%M:%S.%f') as {c}" for c in columns)


def counters(preset):
    return ", ".join(
        f"cast(sum(case when reason = {quoted(reason)} then 1 else 0 end) as bigint) as {name}"
        for name, reason in preset.items())


def any_of(text, words):
    return "(" + " or ".join(f"contains({text}, {quoted(w)})" for w in words) + ")"


def lookback(days):
    return f"data_load_date > date '{AS_OF}' - interval '{days}' day"


RANGE = f"data_load_date between date '{START}' and date '{END}'"
CARRIER_DAY = "account_sid, data_load_date, mcc, mnc"
CARRIER_DAY_SHOWN = f"account_sid, {day()}, mcc, mnc"
TIMES = moment("record_time", "expiry_time")

# Sources and sinks

add("scan_tables", " union all ".join(
    f"select '{t}' as table_name, account_sid, count(*) as n_rows from {t} group by account_sid"
    for t in S.WAREHOUSE_TABLES))
add("run_query", f"""select account_sid, count(*) as n from raw_events
 where product_id = 'Verify' and data_load_date > date '{SINCE}' group by account_sid""")
add("scan_projected", "select event_id, event_type, round(value, 9) as value from events")
add("append_sink", f"""select account_sid, mcc, mnc, {TIMES}, null as note from state_rows
 union all select account_sid, mcc, mnc, {TIMES}, 'new' from new_rows""")
add("overwrite_state_sink", f"""select account_sid, mcc, mnc, {TIMES} from state_rows
 union all select account_sid, mcc, mnc, {TIMES} from new_rows""")
_SNAPSHOT = "select account_sid, account_on_verify, spp_enabled"
add("run_snapshot_sink", f"""
{_SNAPSHOT}, 'account_categorisation' as kind, '2024-01-15' as run_date,
 '2024-01-15_08_05' as run_time from master_old
union all {_SNAPSHOT}, 'amm_threshold', '2024-01-16', '2024-01-16_08_05' from master_new
union all {_SNAPSHOT}, 'unknown', '2024-01-16', '2024-01-16_09_05' from master_new""")
add("archive_layout", " union all ".join(
    f"select '{kind}' as kind, '2024-01-29' as run_date, count(*) as n_rows from {source}"
    for kind, source in {
        "breach_state_data": "state_rows", "dynamic_flooding_data": "new_rows",
        "toll_phone_data": "candidates", "higher_prefix_data": "state_rows",
        "allow_list": "new_rows"}.items()))
add("optional_source", "select prefix, 'present' as source from skiplist")
add("response_log_scan", """select 'AC' || cast(ticket_id as varchar) as account_sid,
 case when turn % 2 = 0 then 'Ecuador' else '[''Iran'', ''Ukraine'']' end as country,
 '[]' as mcc, '[''None'']' as mnc, '['''']' as date, '[]' as error_code,
 'Fraud Guard' as result, '15' as category, 'it''s ' || cast(ticket_id as varchar) as reason
 from tickets""")

# Filters

_TRAFFIC = f"select {CARRIER_DAY_SHOWN}, total_count, round(cr, 9) as cr from traffic_features"
add("filter_account", f"{_TRAFFIC} where account_sid = '{ACCOUNT}'")
add("filter_account_like", f"{_TRAFFIC} where account_sid like 'AC0000_2%'")
add("filter_lookback", f"{_TRAFFIC} where {lookback(15)}")
add("filter_date_range", f"{_TRAFFIC} where {RANGE}")
add("filter_product", f"""select event_id, account_sid, {day()}, {moment('event_ts')}, mcc, mnc,
 product_id, reason, block from raw_events where product_id = 'Messaging'""")
add("filter_mcc", f"{_TRAFFIC} where mcc = '{MCC}'")
_FLAGS = "account_on_verify, account_on_psms, spp_enabled, spp_shadow_enabled"
add("filter_since", f"""select account_sid, {day()}, {_FLAGS} from account_features
 where data_load_date > date '{SINCE}'""")
_LISTS = {k: ", ".join(map(quoted, v)) for k, v in EXCLUDED["do_not_include"].items()}
add("exclusion_override", f"""select event_id, account_sid, mcc, mnc,
 case when mcc in ({_LISTS['mcc']}) or mcc || '_' || mnc in ({_LISTS['mcc_mnc']})
  or mcc || '_' || mnc || '_' || account_sid in ({_LISTS['mcc_mnc_account']})
 then 'No' else block end as block from candidates""")
add("exclusion_override_lists", """select event_id, account_sid, mcc, mnc,
 case when exists (select 1 from state_rows s where s.mcc = c.mcc and (s.mcc in ('201', '203')
  or s.mnc = c.mnc and s.account_sid = c.account_sid)) then 'No' else block end as block
 from candidates c""")
add("expired_filter", f"""select account_sid, mcc, mnc, {TIMES} from state_rows
 where expiry_time > timestamp '{MID}'""")
_LATEST = f"""select * from account_features where data_load_date > date '{SINCE}'
 qualify row_number() over (partition by account_sid order by data_load_date desc) = 1"""
add("account_status", """select account_sid, activity, protection, 'Account ' || account_sid
  || ' is ' || activity || '; message protection is ' || protection as status_text from status""",
    latest=_LATEST,
    status="""select account_sid,
 case when account_on_verify and account_on_psms then 'active on Verify and Messaging'
  when account_on_verify then 'active on Verify only'
  when account_on_psms then 'active on Messaging only' else 'not active' end as activity,
 case when spp_enabled then 'enabled' when spp_shadow_enabled then 'enabled in shadow mode'
  else 'not enabled' end as protection from latest""")
add("is_account_present", """select distinct account_sid, account_sid in
 (select account_sid from account_features where data_load_date > date '2024-01-28')
 as is_present from raw_events""")

# Joins

add("join_friendly_name", f"""select t.account_sid, {day()}, mcc, mnc, total_count,
 round(cr, 9) as cr, friendly_name from traffic_features t
 left join account_names n on t.account_sid = n.account_sid""")
add("skiplist_anti", """select event_id, account_sid, phone_prefix from candidates c
 where not exists (select 1 from skiplist s
  where s.prefix is not distinct from c.phone_prefix)""")
add("cleared_anti", f"""select account_sid, mcc, mnc, {TIMES} from state_rows
 where (account_sid, mcc, mnc) not in (select (account_sid, mcc, mnc) from cleared_keys)""")
add("delta_outer", "select * from master_new except select * from master_old")


def merged(key, rows, where="true", record="record_time", expiry="expiry_time"):
    """Per (key, mcc): sorted mncs and the times of the latest record."""
    return f"""select {key} as key, mcc,
 array_to_string(list_sort(list_distinct(list(mnc))), ',') as mnc,
 max({record}) as record_time, arg_max({expiry}, ({record}, {expiry})) as expiry_time
 from {rows} where {key} is not null and {record} is not null and {expiry} is not null
  and {where} group by {key}, mcc"""


def last_write(rows):
    return f"""select key, mcc, mnc, record_time, expiry_time from {rows} qualify row_number()
 over (partition by key order by record_time desc, mcc desc, mnc desc, expiry_time desc) = 1"""


_KEY_ROWS = f"select key, mcc, mnc, {TIMES}"
add("prefix_merge", f"{_KEY_ROWS} from merged", merged=merged("higher_prefix", "candidates"))
for name in ("block_list_check", "block_list_check_filtered"):
    add(name, """select event_id, phone_prefix, higher_prefix, mnc, mode
 from candidates c where mode = 'good' or not exists (select 1 from stored s
  where (s.key = c.phone_prefix or s.key = c.higher_prefix) and s.mnc = c.mnc)""",
    merged_own=merged("phone_prefix", "candidates", "block = 'Yes'"),
    merged_higher=merged("higher_prefix", "candidates", "higher_prefix_block_flag = 'Yes'",
                         "higher_prefix_record_time", "higher_prefix_expiry_time"),
    own=last_write("merged_own"), higher=last_write("merged_higher"),
    stored="""select distinct key, unnest(string_split(mnc, ',')) as mnc
 from (select * from own union all select * from higher)""")
add("allow_list_check", """select event_id, phone_number from candidates
 where phone_number is null or phone_number not in
 (select phone_number from candidates where mcc = '203' and phone_number is not null)""")
add("delete_keys", f"""{_KEY_ROWS} from held
 where key not in (select prefix from skiplist where prefix is not null)""",
    merged=merged("phone_prefix", "candidates"), held=last_write("merged"))

# Aggregations

_MESSAGES = "cast(sum(total_count) as bigint) as daily_message_count"


def traffic(table, rate, where="true", account=True):
    shown = CARRIER_DAY_SHOWN if account else f"{day()}, mcc, mnc"
    rates = ", round(avg(cr), 9) as daily_avg_cr" if rate else ""
    return f"""select {shown}, {_MESSAGES}{rates} from {table}
 where {lookback(30)} and {where} group by {CARRIER_DAY}"""


add("traffic_daily_verify", traffic("traffic_features", True))
add("traffic_daily_verify_mcc", traffic("traffic_features", True, f"mcc = '{MCC}'"))
add("traffic_daily_msg", traffic("message_traffic_features", False))
add("traffic_daily_msg_mcc", traffic("message_traffic_features", False, f"mcc = '{MCC}'"))
add("traffic_daily_one_account",
    traffic("traffic_features", True, f"account_sid = '{ACCOUNT}'", account=False))


def breakdown(product, preset, where="true", shown=CARRIER_DAY_SHOWN):
    return f"""select {shown}, count(*) as total_traffic, {counters(preset)} from raw_events
 where product_id = '{product}' and {lookback(30)} and {where} group by {CARRIER_DAY}"""


add("block_breakdown_verify", breakdown("Verify", S.VERIFY_BREAKDOWN))
add("block_breakdown_verify_mcc", breakdown("Verify", S.VERIFY_BREAKDOWN, f"mcc = '{MCC}'"))
add("block_breakdown_msg", breakdown("Messaging", S.MESSAGING_BREAKDOWN))
add("block_breakdown_msg_mcc",
    breakdown("Messaging", S.MESSAGING_BREAKDOWN, f"mcc = '{MCC}'"))


def daily(preset, where="true"):
    return f"""select {day()}, {counters(preset)}, count(*) as total_traffic from raw_events
 where {lookback(30)} and {where} group by data_load_date"""


add("daily_metrics_fg", daily(S.DAILY_VERIFY))
add("daily_metrics_spp", daily(S.DAILY_MESSAGING))
add("order_by_ordinal", daily(S.DAILY_VERIFY, "product_id = 'Verify'"))
add("stream_daily_metrics", f"""select {day()}, {counters(S.DAILY_VERIFY)},
 count(*) as total_traffic from raw_events group by data_load_date""")

add("range_totals_verify", f"""select {counters(S.TOTALS_VERIFY)} from raw_events
 where product_id = 'Verify' and {RANGE}""")
add("range_totals_flooding", f"""select {counters(S.TOTALS_FLOODING)} from raw_events
 where product_id = 'Messaging' and {RANGE}""")
add("range_totals_risk", f"select {counters(S.TOTALS_RISK)} from raw_events where {RANGE}")
for name, product, preset in (("range_summary_verify", "Verify", S.SUMMARY_VERIFY),
                              ("range_summary_msg", "Messaging", S.SUMMARY_MESSAGING)):
    add(name, f"""select count(distinct account_sid) as active_accounts, {counters(preset)},
 cast(sum(case when block = false then 1 else 0 end) as bigint) as total_allowed,
 cast(sum(case when block then 1 else 0 end) as bigint) as total_blocked
 from raw_events where product_id = '{product}' and {RANGE}""")

_DAILY_TRAFFIC = f"""select {CARRIER_DAY}, sum(total_count) as daily_message_count,
 avg(cr) as daily_avg_cr from traffic_features where {lookback(30)} group by {CARRIER_DAY}"""
_ROLLED = """cast(sum(daily_message_count) as bigint) as daily_message_count,
 round(avg(daily_avg_cr), 9) as daily_avg_cr from traffic"""
for name in ("account_daily_traffic", "traffic_series"):
    add(name, f"select account_sid, {day()}, {_ROLLED} group by account_sid, data_load_date",
        traffic=_DAILY_TRAFFIC)
add("traffic_by_code", f"select account_sid, mcc, mnc, {_ROLLED} group by account_sid, mcc, mnc",
    traffic=_DAILY_TRAFFIC)
_DAILY_BLOCKS = f"""select account_sid, data_load_date, count(*) as total_traffic,
 {counters(S.VERIFY_BREAKDOWN)} from raw_events where product_id = 'Verify' and {lookback(30)}
 group by account_sid, data_load_date"""
for name in ("account_daily_blocks", "account_daily_blocks_rollup"):
    add(name, f"select * replace (cast(data_load_date as varchar) as"
        " data_load_date) from daily_blocks", daily_blocks=_DAILY_BLOCKS)
add("block_reports", f"""select case grouping(account_sid, mcc) when 0 then 'carrier'
 when 1 then 'account' else 'day' end as report, {CARRIER_DAY_SHOWN}, count(*) as total_traffic,
 {counters(S.VERIFY_BREAKDOWN)} from raw_events where product_id = 'Verify' and {lookback(30)}
 group by grouping sets (({CARRIER_DAY}), (account_sid, data_load_date), (data_load_date))""")
_SERIES = {"classic_fg": "Classic Fg", "spp_block": "Spp Block",
           "risk_score_block": "Risk Score Block", "allowed_messages": "Allowed Messages"}
add("block_series_long", " union all ".join(
    f"select account_sid, {day()}, '{label}' as series, {column} as messages from daily_blocks"
    for column, label in _SERIES.items()), daily_blocks=_DAILY_BLOCKS)
add("service_count", """select account_sid, count(distinct service_sid) as service_sid_count
 from service_events group by account_sid""")

# Ordered groups and deduplication

_SETTINGS = f"""select distinct account_sid, service_sid, friendly_name,
 case when try_cast(json_extract_string(configuration, '$.{S.ENABLED_FIELD}') as boolean)
  then 'enable' else 'disable' end as fraud_guard,
 json_extract_string(configuration, '$.{S.MODE_FIELD}') as fraud_guard_mode, updated_at
 from service_events"""
_HISTORY = """select *, case when lag(fraud_guard_mode) over (
  partition by account_sid, service_sid
  order by updated_at, fraud_guard_mode nulls first, fraud_guard, friendly_name)
 <> fraud_guard_mode then 'Change' else 'No-Change' end as mode_change from settings"""
_HISTORY_SHOWN = f"""select account_sid, service_sid, fraud_guard, fraud_guard_mode,
 {moment('updated_at')}, mode_change from history"""
add("mode_change", f"""select * replace (strftime(updated_at, '%Y-%m-%d %H:%M:%S.%f')
 as updated_at) from history""", settings=_SETTINGS, history=_HISTORY)
for name in ("service_history", "history_newest_first"):
    add(name, _HISTORY_SHOWN, settings=_SETTINGS, history=_HISTORY)
add("service_history_like", f"{_HISTORY_SHOWN} where account_sid like 'AC0000_2%'",
    settings=_SETTINGS, history=_HISTORY)
add("rank_by_update", f"""select account_sid, service_sid, {moment('updated_at')},
 dense_rank() over (partition by account_sid order by updated_at desc) as rank_desc
 from service_events""")
add("latest_flags", f"select account_sid, {day()}, {_FLAGS} from latest", latest=_LATEST)
add("latest_one", f"""select account_sid, {day()}, {_FLAGS} from account_features
 where account_sid = '{ACCOUNT}' order by data_load_date desc limit 1""")
add("distinct_rows", f"""select account_sid, service_sid, fraud_guard, fraud_guard_mode,
 {moment('updated_at')} from settings""", settings=_SETTINGS)
_NEWEST = """select * from settings qualify row_number() over (
 partition by account_sid, service_sid
 order by updated_at desc, fraud_guard_mode desc nulls last, fraud_guard desc) = 1"""
add("latest_service", f"""select account_sid, service_sid, fraud_guard, fraud_guard_mode,
 {moment('updated_at')} from newest""", settings=_SETTINGS, newest=_NEWEST)
add("split_by_status", """select account_sid, service_sid, fraud_guard, fraud_guard_mode
 from newest""", settings=_SETTINGS, newest=_NEWEST)
_LATEST_EXPIRY = """qualify row_number() over (partition by account_sid, mcc, mnc
 order by expiry_time desc, record_time desc) = 1"""
add("dedupe_latest_expiry",
    f"select account_sid, mcc, mnc, {TIMES} from kept",
    kept=f"select * from state_rows {_LATEST_EXPIRY}")
_LOWEST = "account_on_verify nulls last, spp_enabled nulls last"
add("dedupe_key", f"""select * from master_old qualify row_number() over (
 partition by account_sid order by {_LOWEST}) = 1""")
add("dedupe_prefix", f"select higher_prefix, mcc, mnc, {TIMES} from kept",
    kept="""select * from candidates qualify row_number() over (
 partition by higher_prefix, mcc, mnc order by record_time, expiry_time) = 1""")
add("state_sort", f"select account_sid, mcc, mnc, {TIMES} from state_rows")

# Set operations and state

_STATE_SHOWN = f"select account_sid, mcc, mnc, {TIMES}"
add("union_all_by_name", f"""select account_sid, mcc, {moment('record_time')},
 null::varchar as expiry_time from state_rows
 union all select account_sid, mcc, null, {moment('expiry_time')} from new_rows""")
_DELTA = f"""select * from (select * from master_new except select * from master_old)
 qualify row_number() over (partition by account_sid order by {_LOWEST}) = 1"""
_MASTER = f"""select * from (select * from master_new union select * from master_old)
 qualify row_number() over (partition by account_sid order by {_LOWEST}) = 1"""
add("delta_rows", _DELTA)
add("master_merge", _MASTER)
add("master_merge_new", f"""select account_sid, account_on_verify, spp_enabled from
 (select *, 0 as side from master_new union all select *, 1 as side from master_old)
 qualify row_number() over (partition by account_sid order by side, {_LOWEST}) = 1""")
add("merge_and_publish", """select *, 'master' as output from merged
 union all select *, 'delta' from delta""", merged=_MASTER, delta=_DELTA)


def upserted(old):
    return f"""select * from (
  select * from {old}
   where (account_sid, mcc, mnc) not in (select (account_sid, mcc, mnc) from cleared_keys)
  union all select * from new_rows)
 {_LATEST_EXPIRY}"""


for name in ("state_upsert", "state_update_run", "stream_state_upsert"):
    add(name, f"{_STATE_SHOWN} from kept where expiry_time > timestamp '{NOW}'",
        kept=upserted("state_rows"))


def amm(rows):
    return f"""select account_sid || '-' || mcc || '-' || mnc as key, mcc, mnc, record_time,
 expiry_time from {rows}"""


add("insert_if_absent_ttl", f"""select key, {TIMES}, false as inserted from held
 where expiry_time > timestamp '{MID}'
 union all select key, {TIMES}, true from asked where key not in
 (select key from held where expiry_time > timestamp '{MID}')""",
    held_rows=amm("state_rows"), held=last_write("held_rows"),
    asked_rows=amm("new_rows"), asked=last_write("asked_rows"))

_VALUE = f"""{TIMES}, cast((epoch_us(expiry_time) - epoch_us(record_time)) // 1000000 as bigint)
 as ttl_seconds, '{{"mcc":"' || mcc || '","mnc":"' || mnc || '","expiry_time":"'
 || strftime(expiry_time, '%Y-%m-%d %H:%M:%S') || '"}}' as value"""
add("upsert_ttl_keys", f"""select key, mcc, mnc, {_VALUE}
 from (select * from new union all select * from held where key not in (select key from new))
 where expiry_time > timestamp '{NOW}'""",
    merged_old=merged("phone_prefix", "candidates", f"record_time < timestamp '{MID}'"),
    merged_new=merged("phone_prefix", "candidates", f"record_time >= timestamp '{MID}'"),
    held=last_write("merged_old"), new=last_write("merged_new"))
add("account_prefix_keys", f"{_KEY_ROWS} from written",
    keyed="select account_sid || '_' || phone_prefix as prefix_key, * from candidates",
    merged=merged("prefix_key", "keyed"),
    unmerged="""select key, mcc, mnc, record_time, expiry_time from merged union all
 select account_sid || '_' || higher_prefix, mcc, mnc, higher_prefix_record_time,
  higher_prefix_expiry_time from candidates where higher_prefix_block_flag = 'Yes'
  and higher_prefix_record_time is not null and higher_prefix_expiry_time is not null""",
    written=last_write("unmerged"))
for name, key, shown in (
        ("allow_list_build", "'allow_' || sha256('+' || phone_number)", _VALUE),
        ("allow_list_build_plain", "'allow_' || phone_number", TIMES)):
    add(name, f"select key, mcc, mnc, {shown} from written",
        keyed=f"""select {key} as key, mcc, mnc, record_time, expiry_time from candidates
 where phone_number is not null""",
        written=last_write("keyed"))


def s(name):
    return f"""'"{name}":{{"S":"' || {name} || '"}}'"""


def n(name, value=None):
    return f"""'"{name}":{{"N":"' || cast({value or name} as varchar) || '"}}'"""


def flag(name):
    return f"""'"{name}":{{"BOOL":' || cast({name} as varchar) || '}}'"""


def put(*attributes):
    return """'{"PutRequest":{"Item":{' || """ + " || ',' || ".join(attributes) + " || '}}}' as item"


def threshold(model, kind, column):
    return (f"""'{{"M":{{"model_name":{{"S":"{model}"}},"model_type":{{"S":"{kind}"}},' || """
            + n("model_value", f"cast(trunc({column}) as bigint)") + " || '}}'")


add("account_items", "select id, " + put(
    s("id"), s("account_category"), n("block_ttl_mins"), n("lookback_mins"),
    n("default_threshold"), flag("optout"), flag("observe")) + " from account_settings")
add("threshold_items", "select id, " + put(
    *[s(c) for c in ("id", "account_category", "ccr_label", "country_code", "mcc", "mnc")],
    flag("observe"), n("block_ttl_mins"), n("lookback_mins"),
    """'"thresholds":{"L":[' || """ + threshold("account_ucl", "account", "ucl")
    + " || ',' || " + threshold("three_sigma", "statistical", "threshold")
    + " || ']}'") + " from threshold_rows")
add("hash_columns", """select event_id, sha256(account_sid) as sha, md5(account_sid) as md5,
 null::varchar as unknown, sha256(phone_number) as phone_sha from candidates""")

# Ticket triage


def joined(array, sep="|"):
    return f"coalesce(array_to_string({array}, '{sep}'), '')"


def matches(pattern, group=0):
    return f"regexp_extract_all(text, {quoted(pattern[1])}, {group})"


def sorted_set(array):
    return f"list_sort(list_distinct({array}))"


def named(text, words):
    """Any of the words in a text; five-digit codes only where they stand alone."""
    tests = [f"regexp_matches({text}, '\\b{w}\\b')" if w.isdigit()
             else f"contains({text}, {quoted(w)})" for w in words]
    return "(" + " or ".join(tests) + ")"


def labels(text, table):
    cases = ", ".join(f"case when {named(f'lower({text})', words)} then {quoted(label)} end"
                      for label, words in table.items())
    return f"[x for x in [{cases}] if x is not null]"


# What a summary may say for each category: the phrases of a ticket, or the label.
SUMMARY_WORDS = {
    "Enablement": ["enablement", "mode settings", "mode enabled", "history of modes"],
    "SafeList": ["safelist", "adding numbers", "removing numbers"],
    "Risk Check": ["risk check", "riskcheck"],
    "False Negative": ["false negative", "missed fraud", "low conversion rate",
                       "high volume of messages"],
    "False Positive": ["false positive", "genuine messages blocked", "blocked messages"],
    "Refund": ["refund", "credit memo"], "Billing": ["billing", "pricing"],
    "60410": ["60410", "unblocking 30453"], "30450": ["30450"], "30453": ["30453"],
}


def categories(text, table=X.CATEGORY_PHRASES):
    found = labels(text, table)
    return f"case when len({found}) > 0 then {found} else ['{X.OTHERS}'] end"


_COUNTRY_TABLE = "map {" + ", ".join(
    f"{quoted(k)}: {quoted(v)}" for k, v in X.country_names().items()) + "}"


def _plain(found):
    """The same matches over text whose letters beyond ASCII bound no word, as in Java."""
    return found.replace("(text,", "(regexp_replace(text, '[^\\x00-\\x7F]', 'z', 'g'),", 1)


_COUNTRIES = (f"[{_COUNTRY_TABLE}[x] for x in list_concat("
              f"[lower(y) for y in {_plain(matches(X.country_pattern()))}],"
              f" {_plain(matches(X.SHORT_COUNTRY))})]")


def _codes(label, code):
    """Codes of the lists behind a label; the pattern is the oracle's own."""
    listed = rf"(?i)\b{label}s?[ :=]+({code}(?:(?: ?[,/] ?| and | & | or ){code})*)\b"
    undashed = f"regexp_replace(text, '{code}(-[0-9]+)+', '#', 'g')"
    found = f"regexp_extract_all({undashed}, {quoted(listed)}, 1)"
    return f"flatten([regexp_split_to_array(y, '[^0-9]+') for y in {found}])"


FOUND = f"""select ticket_id, turn, role, text, pairs as mcc_mnc,
 nullif(regexp_extract(text, {quoted(X.ACCOUNT_ID[1])}), '') as account_sid,
 {sorted_set(_COUNTRIES)} as country,
 {sorted_set(f"list_concat([split_part(x, '-', 1) for x in pairs], {_codes('mcc', '[2-7][0-9][0-9]')})")}
  as mcc,
 {sorted_set(f"list_concat([split_part(x, '-', 2) for x in pairs], {_codes('mnc', '[0-9]{2,3}')})")}
  as mnc,
 {sorted_set(matches(X.DATE_TEXT))} as date,
 {sorted_set(matches(X.ERROR_CODE))} as error_code,
 {labels('text', X.PRODUCT_WORDS)} as products, {categories('text')} as categories
 from (select *, {sorted_set(f"[x for x in {matches(X.DASHED_NUMBERS)} if regexp_matches(x, {quoted(X.CARRIER_PAIR)})]")}
  as pairs from tickets)"""
_FIELDS = ("account_sid, " + ", ".join(
    f"{joined(c)} as {c}" for c in ("mcc_mnc", "country", "mcc", "mnc", "date", "error_code")))
add("ticket_fields", f"select ticket_id, {_FIELDS} from found", found=FOUND)
add("ticket_products", f"select ticket_id, {joined('products')} as products from found",
    found=FOUND)
for name in ("ticket_categories", "ticket_categories_lexicon"):
    add(name, f"select ticket_id, {joined('categories')} as categories from found", found=FOUND)


def first_decoding(text, branches, default):
    return "case " + " ".join(f"when {any_of(text, words)} then {quoted(label)}"
                              for label, words in branches) + f" else {default} end"


def decode_issue(text):
    return first_decoding(f"lower({text})", X.ISSUE_DECODING, quoted(X.OTHERS))


_DECODED = first_decoding("lower(x)", X.PRODUCT_DECODING, "null")
add("decode_products", f"""select ticket_id, {joined(
    f"[y for y in [{_DECODED} for x in answers] if y is not null]")} as decoded
 from (select ticket_id, list_concat(products, error_code, ['none of these']) as answers
  from found)""", found=FOUND)
add("decode_issue", f"""select ticket_id, {decode_issue('text')} as of_text,
 {decode_issue("array_to_string(categories, ' ')")} as of_categories,
 {decode_issue('role')} as of_role from found""", found=FOUND)
_LOOSE = "coalesce(starts_with(account_sid, 'AC'), false)"
_STRICT = f"coalesce({_LOOSE} and length(account_sid) = 34, false)"
add("account_id_check", f"""select ticket_id, account_sid, {_LOOSE} as is_account_id,
 {_STRICT} as is_full_account_id from found""", found=FOUND)

_BODY = """select ticket_id, response, regexp_replace(regexp_replace(
  coalesce(nullif(regexp_extract(case when contains(response, '</think>')
   then split_part(response, '</think>', 2) else response end, '(?s)\\{.*\\}'), ''), response), '(?i)"category"\\s*:', '"category":', 'g'),
  '(?i)"reason"\\s*:', '"reason":', 'g') as body from responses"""
_VALID = """case when json_valid(body) then coalesce(json_type(body, '$.category') = 'ARRAY'
 and json_type(body, '$.reason') = 'VARCHAR', false) else false end"""
_CATEGORY = "json_extract_string(body, '$.category[*]')"
_REASON = "json_extract_string(body, '$.reason')"
add("parse_responses", f"""select ticket_id, response, {joined(_CATEGORY)} as category,
 {_REASON} as reason from bodies where {_VALID}""", bodies=_BODY)
add("parse_rejects", f"select ticket_id, response from bodies where not ({_VALID})",
    bodies=_BODY)

_REPLY_LIST = "[x for x in [" + ", ".join(
    f"case when list_contains(categories, {quoted(c)}) then {quoted(r)} end"
    for c, r in REPLIES.items()) + "] if x is not null]"
_REPLY = f"""concat_ws(chr(10),
 nullif(array_to_string(list_filter(replies, lambda x, i: list_position(replies, x) = i),
  chr(10)), ''),
 case when not {_LOOSE} then {quoted(ASK_ACCOUNT)} end,
 case when list_contains(categories, '{X.OTHERS}') then {quoted(ASK_DETAIL)} end)"""
add("ticket_reply", f"""select ticket_id, {_REPLY} as reply from
 (select *, {_REPLY_LIST} as replies from found)""", found=FOUND)

add("issue_details", f"""select ticket_id, '1. '
 || case when {_LOOSE} then 'Account: ' || account_sid else {quoted(ASK_ACCOUNT)} end
 || chr(10) || '2. ' || case when len(products) > 0 then 'Product: '
  || array_to_string(products, ', ') else 'Please say which product is affected.' end
 || chr(10) || '3. ' || case when label is null then {quoted(ASK_DETAIL)}
  else 'Issue: ' || label || '; reason: ' || coalesce(reason, 'not given') end as details
 from (select f.*, case when p.category <> '' then {decode_issue('p.category')} end as label,
  p.reason from found f join parsed p on f.ticket_id = p.ticket_id)""",
    found=FOUND, bodies=_BODY,
    parsed=f"""select ticket_id, case when {_VALID} then {joined(_CATEGORY, ' ')} end
 as category, case when {_VALID} then {_REASON} end as reason from bodies""")

add("transcript", """select conv_id, turn // 100 as page,
 string_agg(coalesce(role, '') || ': ' || coalesce(text, ''), chr(10) order by turn) as transcript
 from conversations group by conv_id, turn // 100""")
add("transcript_lines", """select conv_id, turn,
 coalesce(role, '') || ': ' || coalesce(text, '') as line from conversations""")

_HELP_WORDS = sorted({*X.HELP_WORDS, *[
    w for table in (X.PRODUCT_WORDS, X.CATEGORY_PHRASES) for ws in table.values() for w in ws]})
_CONFIRMS = r"^\s*(?:" + "|".join(X.CONFIRM_WORDS) + r")\b"
add("route_messages", f"""select conv_id, turn, case
 when regexp_matches(text, {quoted(X.ACCOUNT_ID[1])}) or {any_of('lower(text)', _HELP_WORDS)}
  then '{HELP}'
 when regexp_matches(lower(text), {quoted(_CONFIRMS)}) and turn > 0 then '{DETAILS}'
 else '{GENERAL}' end as route from messages""")


def summary_part(label, array):
    return (f"case when len({array}) > 0 then '{label}: ' || array_to_string({array}, ', ')"
            " end")


_SUMMARY = f"""concat_ws('; ', 'account: ' || account_sid, {summary_part('country', 'country')},
 {summary_part('product', 'products')}, {summary_part('issue', 'categories')})"""
add("ticket_summary", f"select ticket_id, {_SUMMARY} as summary from found", found=FOUND)
_DETAILS = f"""'1. ' || case when {_LOOSE} then 'Account: ' || account_sid
 else {quoted(ASK_ACCOUNT)} end || chr(10) || '2. ' || case when len(products) > 0 then 'Product: '
  || array_to_string(products, ', ') else 'Please say which product is affected.' end
 || chr(10) || '3. Issue: ' || array_to_string(categories, ', ') || '; reason: '
 || summary"""
add("triage_report", f"""select ticket_id, {_FIELDS}, {joined('products')} as products,
 {joined(f"[y for y in [{_DECODED} for x in products] if y is not null]")} as decoded_products,
 {_DETAILS} as details,
 {joined('categories')} as categories, summary,
 {joined(categories('summary', SUMMARY_WORDS))} as summary_categories, {_LOOSE} as is_account_id,
 {_STRICT} as is_full_account_id, {_REPLY} as reply
 from (select *, {_SUMMARY} as summary, {_REPLY_LIST} as replies from found)""", found=FOUND)

add("account_page", """select s.*, n.service_sid_count from status_rows s left join
 (select account_sid, count(distinct service_sid) as service_sid_count from service_events
  group by account_sid) n on s.account_sid = n.account_sid""",
    status_rows=ORACLES["account_status"])

# Model hooks

add("render_prompts", f"""select ticket_id, {quoted(SYSTEM_TEXT)} as system_prompt,
 'Query : ' || trim(text, ' ') as user_prompt from tickets""")
_LENGTH = "cast(length('Query : ' || trim(text, ' ')) as varchar)"
add("score_new", f"select ticket_id, 'model:' || {_LENGTH} as answer from tickets")
add("score_batch", f"select ticket_id, 'model:' || {_LENGTH} as answer from tickets")
add("model_compare", "select ticket_id, " + ", ".join(
    f"'{m}:' || {_LENGTH} as {m}" for m in ("model_a", "model_b", "model_c"))
    + " from tickets")
