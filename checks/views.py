"""Operator inputs derived from the given tables; the same SQL in Spark and DuckDB."""

import re

BASE_TABLES = {
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string,"
              " value double, props string",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}

_ACCOUNT = "'AC' || lpad(cast(user_id as string), 6, '0')"
_CARRIER = """cast(200 + user_id % 7 as string) as mcc,
  lpad(cast(event_id % 4 as string), 2, '0') as mnc"""
_PHONE = "lpad(cast(user_id * 7919 % 1000000 as string), 6, '0')"

VIEWS = {
    "raw_events": f"""
select event_id, {_ACCOUNT} as account_sid, cast(ts as date) as data_load_date,
  cast(ts as timestamp) as event_ts, {_CARRIER},
  case when event_id % 3 = 0 then 'Messaging' else 'Verify' end as product_id,
  case event_id % 11 when 0 then 'FraudGuardPrefixBlock'
    when 1 then 'FraudGuardSmsFloodingBlock'
    when 2 then 'FraudGuardSmsPumpingRiskScoreBlock'
    when 3 then 'SmsPumpingRiskScoreBlock' when 4 then 'fgl_safe_mcc_mnc'
    when 5 then 'fgl_pass_safe_mcc_request' when 6 then 'GeopermissionCountryBlock'
    when 7 then 'GeopermissionPrefixBlock' when 8 then 'TrustGuardBlock'
    when 9 then null else '' end as reason,
  case when event_id % 11 in (0,1,2,3,6,7,8) then true
    when event_id % 11 = 9 then null else false end as block
from events""",
    "traffic_features": f"""
select {_ACCOUNT} as account_sid, cast(ts as date) as data_load_date, {_CARRIER},
  event_id % 97 as total_count,
  case when event_id % 13 = 0 then null else value / 487 end as cr
from events where event_id % 3 <> 0""",
    "message_traffic_features": f"""
select {_ACCOUNT} as account_sid, cast(ts as date) as data_load_date, {_CARRIER},
  event_id % 97 as total_count
from events where event_id % 3 = 0""",
    "account_features": f"""
select distinct {_ACCOUNT} as account_sid, cast(ts as date) as data_load_date,
  user_id % 2 = 0 as account_on_verify, user_id % 3 = 0 as account_on_psms,
  case when user_id % 7 = 0 then null else day(ts) % 2 = 0 end as spp_enabled,
  user_id % 4 = 0 as spp_shadow_enabled
from events""",
    "service_events": f"""
select {_ACCOUNT} as account_sid,
  'VA' || cast(user_id as string) || '_' || cast(event_id % 3 as string) as service_sid,
  'name' || cast(event_id % 2 as string) as friendly_name,
  case event_id % 7 when 6 then '{{}}'
    when 5 then '{{"allowTollFraudAutoBlockingEnabled": null, "fraudGuardMode": null}}'
    else '{{"allowTollFraudAutoBlockingEnabled": '
      || case when event_id % 2 = 0 then 'true' else 'false' end
      || ', "fraudGuardMode": "'
      || case event_id % 5 when 0 then 'basic' when 1 then 'standard' else 'max' end
      || '"}}' end as configuration,
  cast(ts as timestamp) as updated_at
from events""",
    "candidates": f"""
select event_id, {_ACCOUNT} as account_sid, {_CARRIER},
  case when event_id % 101 = 0 then null else '1' || {_PHONE} end as phone_number,
  case when event_id % 101 = 0 then null
    else '1' || substr({_PHONE}, 1, 4) || 'x' end as phone_prefix,
  '1' || substr({_PHONE}, 1, 2) || 'x' as higher_prefix,
  case when event_id % 6 = 0 then 'Yes' else 'No' end as higher_prefix_block_flag,
  case when event_id % 5 = 0 then 'good' else 'bad' end as mode,
  case when event_id % 4 = 0 then 'No' else 'Yes' end as block,
  cast(ts as timestamp) as record_time,
  cast(ts as timestamp) + (event_id % 72) * interval '1' hour as expiry_time,
  case when event_id % 12 = 0 then null else cast(ts as timestamp) end
    as higher_prefix_record_time,
  cast(ts as timestamp) + (event_id % 48) * interval '1' hour as higher_prefix_expiry_time
from events""",
    "state_rows": """
select account_sid, mcc, mnc, record_time, expiry_time from candidates
where record_time < timestamp '2024-01-16 00:00:00'""",
    "new_rows": """
select account_sid, mcc, mnc, record_time, expiry_time from candidates
where record_time >= timestamp '2024-01-16 00:00:00'""",
    "cleared_keys": """
select account_sid, mcc, mnc from candidates group by account_sid, mcc, mnc
having sum(case when mode = 'good' then 1 else 0 end) * 5 >= count(*)""",
    "skiplist": """
select distinct phone_prefix as prefix from candidates
where phone_prefix is null or mcc in ('200', '203')""",
    "account_names": """
select account_sid, 'name of ' || account_sid as friendly_name from account_features
where account_on_verify group by account_sid""",
    "master_old": """
select account_sid, account_on_verify, spp_enabled from account_features
where data_load_date <= date '2024-01-15'""",
    "master_new": """
select account_sid, spp_enabled or account_on_psms as account_on_verify, spp_enabled
from account_features where data_load_date > date '2024-01-15'""",
    "account_settings": f"""
select {_ACCOUNT} as id,
  case when count(*) > 70 then 'busy' else 'quiet' end as account_category,
  60 * (1 + count(*) % 5) as block_ttl_mins, 1440 as lookback_mins,
  max(event_id % 97) as default_threshold,
  count(*) % 2 = 0 as optout, count(*) % 3 = 0 as observe
from events group by user_id""",
    "threshold_rows": """
select account_sid || '-' || mcc || '-' || mnc as id,
  case when count(*) > 15 then 'busy' else 'quiet' end as account_category,
  'label' || cast(count(*) % 3 as string) as ccr_label, 'C' || mcc as country_code,
  mcc, mnc, count(*) % 2 = 0 as observe,
  60 * (1 + count(*) % 5) as block_ttl_mins, 1440 as lookback_mins,
  max(cr) * 500 as ucl, max(cr) * 750 as threshold
from traffic_features group by account_sid, mcc, mnc having max(cr) is not null""",
    "tickets": """
select conv_id * 1000 + turn as ticket_id, conv_id, turn, role,
  text || case when conv_id % 5 = 4 then ''
    else ' Account AC' || lpad(cast(conv_id as string), 32, '0') end
  || ' on 310-260 and 405-12'
  || case conv_id % 12 when 0 then ' in Canada' when 1 then ' in the United States'
    when 2 then ' in italy' when 3 then ' in China' when 4 then ' in Pakistan'
    when 5 then ' in kenya' when 6 then ' in the UK' when 7 then ' in nigeria'
    when 8 then ' in the UAE' when 9 then ' in South Korea and Guinea-Bissau'
    when 10 then ' in PERU' else ' nowhere, tell us' end
  || case conv_id % 3 when 0 then ' since January 2024'
    when 1 then ' on 2024-01-15, mcc 222' else '' end || ' got '
  || case turn % 4 when 0 then 'error 60410 in Fraud Guard max mode'
    when 1 then '30450 on SMS PP, please refund'
    when 2 then '30453 shadow mode, genuine messages blocked'
    else 'hello there' end || '.' as text
from conversations""",
    "messages": """
select conv_id, turn, role, case turn % 4
    when 3 then 'Yes, that is correct. ' || text when 1 then text
    when 2 then text || ' Please refund the charges.'
    else text || ' Account AC' || lpad(cast(conv_id as string), 32, '0') end as text
from conversations""",
    "responses": """
select ticket_id, case when turn % 2 = 0 then '<think>step</think>' else '' end
  || case ticket_id % 6 when 4 then '{bad'
    when 3 then '{"category": "Refund", "reason": "text, not a list"}'
    when 2 then '{"category": []}'
    when 5 then 'Here it is:' || chr(10) || '```json' || chr(10)
      || '{"category": ["Billing"], "reason": "f' || cast(ticket_id as string) || '"}'
      || chr(10) || '```'
    when 1 then '{"Category": ["Billing"], "Reason": "r' || cast(ticket_id as string) || '"}'
    else '{"category": ["60410", "Refund"], "reason": "r' || cast(ticket_id as string)
      || '"}' end as response
from tickets""",
    "response_log": """
select ticket_id, 'user_id: [Agent 1: account_sid=''AC' || cast(ticket_id as string)
  || ''' country=' || case turn % 2 when 0 then '''Ecuador''' else '[''Iran'', ''Ukraine'']' end
  || ' mcc=[] mnc=[''None''] date=[''''] error_code=[] ,Agent 2: result=''Fraud Guard'' '
  || ',Agent 3: category=''15'' reason="it''s ' || cast(ticket_id as string) || '" ,]' as value
from tickets""",
}

_NAME = re.compile(r"\b(?:" + "|".join([*VIEWS, *BASE_TABLES]) + r")\b")


def needs(sql):
    """Views and tables a SQL text reads, in order of first mention."""
    return list(dict.fromkeys(
        name for name in re.findall(r"\b(?:from|join)\s+(\w+)", sql) if _NAME.fullmatch(name)))


def closure(names):
    """Tables and views needed for ``names``, each after the ones it reads."""
    ordered = []

    def visit(name):
        if name not in ordered:
            for inner in needs(VIEWS.get(name, "")):
                visit(inner)
            ordered.append(name)

    for name in names:
        visit(name)
    return ordered


class Data:
    """Given tables and derived views over one folder, read only when asked for."""

    def __init__(self, spark, sf_dir, **streams):
        self.spark, self.sf_dir, self.streams = spark, sf_dir, streams

    def __getattr__(self, name):
        if name not in VIEWS and name not in BASE_TABLES:
            raise AttributeError(name)
        for part in closure([name]):
            self._frame(part).createOrReplaceTempView(part)
        return self.spark.table(name)

    def _frame(self, name):
        if name in VIEWS:
            return self.spark.sql(VIEWS[name])
        if name in self.streams:
            return self.streams[name]
        return self.spark.read.schema(BASE_TABLES[name]).parquet(f"{self.sf_dir}/{name}.parquet")
