"""Input schemas and fixed values.

``mcc`` and ``mnc`` stay strings: leading zeros carry meaning.
"""

from pyspark.sql import types as T


def _struct(**fields):
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


STR, LONG, DBL, BOOL = T.StringType(), T.LongType(), T.DoubleType(), T.BooleanType()
DATE, TS, STRS = T.DateType(), T.TimestampType(), T.ArrayType(T.StringType())

RAW_EVENTS = _struct(
    account_sid=STR, data_load_date=DATE, event_ts=TS, mcc=STR, mnc=STR,
    product_id=STR, reason=STR, block=BOOL,
)
TRAFFIC_FEATURES = _struct(
    account_sid=STR, data_load_date=DATE, mcc=STR, mnc=STR, total_count=LONG, cr=DBL,
)
MESSAGE_TRAFFIC_FEATURES = _struct(
    account_sid=STR, data_load_date=DATE, mcc=STR, mnc=STR, total_count=LONG,
)
ACCOUNT_FEATURES = _struct(
    account_sid=STR, data_load_date=DATE, account_on_verify=BOOL, account_on_psms=BOOL,
    spp_enabled=BOOL, spp_shadow_enabled=BOOL,
)
SERVICE_EVENTS = _struct(
    account_sid=STR, service_sid=STR, friendly_name=STR, configuration=STR, updated_at=TS,
)
WAREHOUSE_TABLES = {
    "raw_events": RAW_EVENTS,
    "traffic_features": TRAFFIC_FEATURES,
    "message_traffic_features": MESSAGE_TRAFFIC_FEATURES,
    "account_features": ACCOUNT_FEATURES,
    "service_events": SERVICE_EVENTS,
}

STATE_KEY = ["account_sid", "mcc", "mnc"]
STATE = _struct(account_sid=STR, mcc=STR, mnc=STR, record_time=TS, expiry_time=TS)
TTL_KEYS = _struct(key=STR, mcc=STR, mnc=STR, record_time=TS, expiry_time=TS)
SKIPLIST = _struct(prefix=STR)

# Records a triage response must parse to; every field is required.
ACCOUNT_RECORD = _struct(
    account_sid=STR, country=STRS, mcc=STRS, mnc=STRS, date=STRS, error_code=STRS,
)
ISSUE_RECORD = _struct(category=STRS, reason=STR)
PRODUCT_RECORD = _struct(result=STRS)

# Products, JSON fields and reasons as stored in the tables.
VERIFY = "Verify"
MESSAGING = "Messaging"
ENABLED_FIELD = "allowTollFraudAutoBlockingEnabled"
MODE_FIELD = "fraudGuardMode"

ALLOWED = ""
PREFIX_BLOCK = "FraudGuardPrefixBlock"
FLOODING_BLOCK = "FraudGuardSmsFloodingBlock"
VERIFY_RISK_BLOCK = "FraudGuardSmsPumpingRiskScoreBlock"
MESSAGING_RISK_BLOCK = "SmsPumpingRiskScoreBlock"
SAFE_CARRIER = "fgl_safe_mcc_mnc"
SAFE_REQUEST = "fgl_pass_safe_mcc_request"
GEO_COUNTRY_BLOCK = "GeopermissionCountryBlock"
GEO_PREFIX_BLOCK = "GeopermissionPrefixBlock"
TRUST_BLOCK = "TrustGuardBlock"

_SAFE_AND_ALLOWED = {
    "fgl_safe_mcc_mnc": SAFE_CARRIER,
    "fgl_pass_safe_mcc_request": SAFE_REQUEST,
    "allowed_messages": ALLOWED,
}

# Output column -> reason counted in it. The same column name stands for
# different reasons in different reports, hence one preset per report.
VERIFY_BREAKDOWN = {
    "classic_fg": PREFIX_BLOCK,
    "spp_block": FLOODING_BLOCK,
    "risk_score_block": VERIFY_RISK_BLOCK,
    **_SAFE_AND_ALLOWED,
}
MESSAGING_BREAKDOWN = {
    "spp_block": FLOODING_BLOCK,
    "risk_score_block": MESSAGING_RISK_BLOCK,
    **_SAFE_AND_ALLOWED,
}
DAILY_VERIFY = {
    "classic_fg_block": PREFIX_BLOCK,
    "spp_block": FLOODING_BLOCK,
    "risk_score_block": VERIFY_RISK_BLOCK,
    **_SAFE_AND_ALLOWED,
}
DAILY_MESSAGING = MESSAGING_BREAKDOWN
TOTALS_VERIFY = {
    "verify_prefix": PREFIX_BLOCK, "spp": FLOODING_BLOCK, "allowed_messages": ALLOWED,
}
TOTALS_FLOODING = {"flooding_block": FLOODING_BLOCK, "allowed_messages": ALLOWED}
TOTALS_RISK = {
    "riskscore": VERIFY_RISK_BLOCK, "sppriskscore": MESSAGING_RISK_BLOCK,
    "allowed_messages": ALLOWED,
}
SUMMARY_VERIFY = {
    "verify_prefix": PREFIX_BLOCK,
    "flooding": FLOODING_BLOCK,
    "riskscore": VERIFY_RISK_BLOCK,
    "geo_perm_country_block": GEO_COUNTRY_BLOCK,
    "geo_perm_prefix_block": GEO_PREFIX_BLOCK,
    **_SAFE_AND_ALLOWED,
}
SUMMARY_MESSAGING = {
    "flooding": FLOODING_BLOCK,
    "riskscore": MESSAGING_RISK_BLOCK,
    "tg_block": TRUST_BLOCK,
    **_SAFE_AND_ALLOWED,
}
BLOCK_SERIES = ["classic_fg", "spp_block", "risk_score_block", "allowed_messages"]
