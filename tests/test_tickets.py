import json
import random
import re

import pandas as pd
import pytest
from conftest import rows
from pyspark.sql import functions as F

from tollwatch import schemas as S
from tollwatch.functions import text as X
from tollwatch.operators import scoring, tickets
from tollwatch.plans import reports
from tollwatch.sources import tables

FULL_ID = "AC" + "0" * 32


def one(spark, text):
    return spark.createDataFrame([(1, text)], "ticket_id long, text string")


def fields(spark, text):
    return tickets.ticket_fields(one(spark, text)).first()


def test_fields_of_a_full_ticket(spark):
    got = fields(spark, "Account AC123456789 in the United States and Canada, MCC: 222 mnc 07,"
                        " 310-260 and 405-12, since January 2024 and 2024-03-01: 60410, 60410")
    assert got.account_sid == "AC123456789"
    assert got.country == ["Canada", "United States"]
    assert got.mcc_mnc == ["310-260", "405-12"]
    assert got.mcc == ["222", "310", "405"] and got.mnc == ["07", "12", "260"]
    assert got.date == ["2024-03-01", "January 2024"]
    assert got.error_code == ["60410"]


@pytest.mark.parametrize("text", ["", "ACTION needed, ACME", "call 555-123-4567 or 12-34",
                                  "code 1234 or 123456, mcc 99"])
def test_nothing_to_find(spark, text):
    got = fields(spark, text)
    assert got.account_sid is None
    assert [got.country, got.mcc_mnc, got.mcc, got.mnc, got.date, got.error_code] == [[]] * 6


def test_null_text(spark):
    got = reports.triage_report(one(spark, None)).first()
    assert got.account_sid is None and got.categories == [X.OTHERS]
    assert tickets.ASK_ACCOUNT in got.reply and tickets.ASK_DETAIL in got.reply


def labelled(spark, text):
    frame = tickets.ticket_categories(tickets.ticket_products(one(spark, text)))
    row = frame.first()
    assert frame.columns == ["ticket_id", "text", "products", "categories"]
    return row.products, row.categories


@pytest.mark.parametrize("table, pick", [(X.PRODUCT_WORDS, 0), (X.CATEGORY_PHRASES, 1)])
def test_every_word_finds_its_label(spark, table, pick):
    for label, words in table.items():
        for word in words:
            assert label in labelled(spark, f"about {word.upper()}!")[pick]


def test_labels_keep_table_order_and_default(spark):
    assert labelled(spark, "refund for 30453, shadow mode, 60410 in Verify") == (
        ["Fraud Guard", "Shadow Mode"], ["Refund", "60410", "30453"])
    assert labelled(spark, "unblocking 30453")[1] == ["60410", "30453"]
    assert labelled(spark, "hello") == ([], [X.OTHERS])


def by_hand(branches, text, default=None):
    for label, words in branches:
        if any(w in text.lower() for w in words):
            return label
    return default


def test_decoding_follows_branch_order(spark):
    texts = ["nothing here", "False Negative", "Billing", "60410", "30450", "30453", None]
    texts += [w for _, words in X.ISSUE_DECODING + X.PRODUCT_DECODING for w in words]
    frame = spark.createDataFrame([(t,) for t in texts], "text string")
    got = frame.select("text", X.decode_issue("text").alias("issue"),
                       X.decode_products(F.array("text")).alias("products")).collect()
    for row in got:
        text = row.text or ""
        assert row.issue == by_hand(X.ISSUE_DECODING, text, X.OTHERS)
        product = by_hand(X.PRODUCT_DECODING, text)
        assert row.products == ([] if product is None else [product])
    issues = {r.text: r.issue for r in got}
    assert issues["60410"] == "Enablement related"
    assert issues["30450"] == issues["30453"] == "Missed detecting fraud"
    assert "High volume of 30453 detected" not in issues.values()


def test_product_repeats_stay(spark):
    got = spark.range(1).select(X.decode_products(F.array(*map(F.lit, [
        "30450", "30453", "what", "Verify", "shadow", "algo"]))).alias("p")).first().p
    assert got == ["Shadow mode", "Shadow mode", "Fraud Guard", "Shadow mode", "Algo mode"]


def test_account_id_check(spark):
    frame = spark.createDataFrame([(FULL_ID,), ("AC1",), ("ac1",), ("",), (None,)],
                                  "account_sid string")
    assert rows(tickets.account_id_check(frame), "is_account_id", "is_full_account_id") == [
        (False, False), (False, False), (False, False), (True, False), (True, True)]


@pytest.mark.parametrize("response, category", [
    ('{"category": ["a"], "reason": "r"}', ["a"]),
    ('<think>{"category": 1}</think>\n {"Category": ["a", "b"], "REASON" : "r"}', ["a", "b"]),
    ('{"category": [], "reason": ""}', []),
    ('{"category": ["say \\"Category\\": no"], "reason": "r"}', ['say "Category": no']),
    ('{"category": "a", "reason": "r"}', None), ('{"category": ["a"]}', None),
    ('{"category": ["a"], "reason": null}', None), ("{bad", None), ("", None), (None, None)])
def test_responses(spark, response, category):
    frame = spark.createDataFrame([(1, response)], "ticket_id long, response string")
    parsed = tickets.parse_responses(frame, S.ISSUE_RECORD)
    kept, dropped = tickets.accepted(parsed).collect(), tickets.rejected(parsed).collect()
    assert len(kept) + len(dropped) == 1
    assert [r.category for r in kept] == ([] if category is None else [category])


def test_account_and_product_records(spark):
    account = {"account_sid": "AC1", "country": ["X"], "mcc": [], "mnc": [], "date": [],
               "error_code": ["60410"]}
    frame = spark.createDataFrame([(1, json.dumps(account))], "ticket_id long, response string")
    got = tickets.accepted(tickets.parse_responses(frame, S.ACCOUNT_RECORD)).first()
    assert got.error_code == ["60410"] and got.account_sid == "AC1"
    frame = spark.createDataFrame([(1, '{"result": ["A"]}')], "ticket_id long, response string")
    assert tickets.accepted(tickets.parse_responses(frame, S.PRODUCT_RECORD)).first().result == ["A"]


def test_reply(spark):
    frame = spark.createDataFrame(
        [("AC1", ["60410", "Refund", "30450"]), (None, [X.OTHERS]), ("AC1", None), ("AC1", [])],
        "account_sid string, categories array<string>")
    got = [r.reply for r in tickets.ticket_reply(frame).collect()]
    assert got == [tickets.REPLIES["60410"] + "\n" + tickets.REPLIES["Refund"],
                   tickets.ASK_ACCOUNT + "\n" + tickets.ASK_DETAIL,
                   tickets.ASK_DETAIL, tickets.ASK_DETAIL]


def test_details(spark):
    frame = spark.createDataFrame(
        [("AC1", ["A", "B"], "c", "r"), (None, [], None, None)],
        "account_sid string, products array<string>, category string, reason string")
    first, second = [r.details for r in tickets.issue_details(frame).collect()]
    assert first == "1. Account: AC1\n2. Product: A, B\n3. Issue: c; reason: r"
    assert tickets.ASK_ACCOUNT in second and tickets.ASK_DETAIL in second


@pytest.mark.parametrize("text, turn, route", [
    ("Yes", 1, tickets.DETAILS), (" confirm please", 3, tickets.DETAILS),
    ("Yes", 0, tickets.GENERAL), ("yesterday", 2, tickets.GENERAL), ("hi", 2, tickets.GENERAL),
    ("Yes, use AC123 instead", 1, tickets.HELP), ("a REFUND please", 0, tickets.HELP)])
def test_routes(spark, text, turn, route):
    frame = spark.createDataFrame([(1, turn, "user", text)],
                                  "conv_id long, turn long, role string, text string")
    assert tickets.route_messages(frame).first().route == route


def test_transcript_pages(spark):
    frame = spark.range(0, 250).selectExpr(
        "1L as conv_id", "249 - id as turn", "'user' as role",
        "cast(249 - id as string) as text")
    got = sorted(tickets.transcript(frame).collect(), key=lambda r: r.page)
    assert [len(r.transcript.split("\n")) for r in got] == [100, 100, 50]
    assert got[0].transcript.startswith("user: 0\nuser: 1\n")
    lines = [r.line for r in tickets.transcript_lines(frame).collect()]
    assert lines == [f"user: {i}" for i in range(250)]


def test_transcript_pages_are_bounded_for_repeated_turns(spark):
    frame = spark.range(0, 1250).selectExpr(
        "if(id < 250, 1L, if(id < 1249, 2L, null)) as conv_id", "if(id < 250, 0L, id % 3) as turn",
        "'user' as role", "lpad(cast(id as string), 4, '0') as text")
    got = {(r.conv_id, r.page): r.transcript.split("\n")
           for r in tickets.transcript(frame).collect()}
    assert {k: len(v) for k, v in got.items()} == {
        (1, 0): 100, (1, 1): 100, (1, 2): 50, **{(2, k): 100 for k in range(9)}, (2, 9): 99,
        (None, 0): 1}
    assert [x for k in range(3) for x in got[1, k]] == [f"user: {i:04}" for i in range(250)]
    assert [x for k in range(10) for x in got[2, k]] == [
        f"user: {i:04}" for i in sorted(range(250, 1249), key=lambda i: (i % 3, i))]


def test_triage_needs_no_shuffle_and_no_python(spark):
    plan = reports.triage_report(one(spark, "x"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Pandas" not in plan


def test_long_text_is_read_to_its_end(spark):
    got = reports.triage_report(one(spark, "lorem ipsum " * 50_000 + f"{FULL_ID} refund")).first()
    assert got.account_sid == FULL_ID and got.categories == ["Refund"]


def test_models_side_by_side(spark):
    prompts = tickets.render_prompts(one(spark, " hello "), "system")
    row = prompts.first()
    assert (row.system_prompt, row.user_prompt) == ("system", "Query : hello")
    upper = lambda s: s.str.upper()
    size = lambda s: pd.Series([str(len(x)) for x in s])
    got = scoring.model_compare(prompts, {"a": upper, "b": size}).first()
    assert (got.a, got.b) == ("QUERY : HELLO", "13")
    assert scoring.score_batch(prompts, upper).first().answer == "QUERY : HELLO"


def test_response_log(spark, path):
    with open(path("log"), "w") as f:
        f.write("user_id: [Agent 1: account_sid='ACx1' country='None' mcc=[] mnc=['None', 'a']"
                " date=[''] error_code=['60410'] ,Agent 2: result='1' ,Agent 3: category=15"
                " reason=\"it's, so\" ,]user_id: [Agent 1: account_sid='ACx2' country=['A', 'B']"
                " ,Agent 3: category=['x'] reason='y' ,]\n")
    got = sorted(tables.read_response_log(spark, path("log")).collect())
    assert len(got) == 2
    assert got[0].mnc == "['None', 'a']" and got[0].category == "15"
    assert got[0].reason == "it's, so" and got[0].result == "1" and got[0].country == "None"
    assert got[1].country == "['A', 'B']" and got[1].result is None and got[1].mcc is None


def test_messages_without_text_or_role_stay(spark):
    frame = spark.createDataFrame([(1, 0, "user", None), (1, 1, None, "x"), (1, 2, "user", "y")],
                                  "conv_id long, turn long, role string, text string")
    assert tickets.transcript(frame).first().transcript == "user: \n: x\nuser: y"
    assert [r.line for r in tickets.transcript_lines(frame).collect()] == [
        "user: ", ": x", "user: y"]


def test_codes_inside_longer_numbers_are_no_category(spark):
    frame = spark.createDataFrame([(1, "13045012 and AC1330450x"), (2, "code 30450, 60410.")],
                                  "ticket_id long, text string")
    got = {r.ticket_id: r for r in tickets.ticket_products(
        tickets.ticket_categories(frame)).collect()}
    assert (got[1].categories, got[1].products) == (["Others"], [])
    assert got[2].categories == ["60410", "30450"]


@pytest.mark.parametrize("label", X.CATEGORY_PHRASES)
def test_the_summary_keeps_the_category(spark, label):
    text = X.CATEGORY_PHRASES[label][0]
    frame = spark.createDataFrame([(1, text)], "ticket_id long, text string")
    row = reports.triage_report(frame).first()
    assert row.summary_categories == row.categories and label in row.categories


def test_answers_in_a_fence_or_after_a_sentence(spark):
    good = '{"category": ["Refund"], "reason": "r"}'
    answers = [f"```json\n{good}\n```", f"The answer is: {good} Bye.", f"<think>{{}}</think>\n{good}"]
    frame = spark.createDataFrame(list(enumerate(answers)), "ticket_id long, response string")
    got = tickets.parse_responses(frame, S.ISSUE_RECORD).collect()
    assert all(r.is_valid and r.category == ["Refund"] for r in got)


def test_log_records_without_an_account_stay(spark, path):
    spark.createDataFrame([("a country='Iran' ,]",), (" \n",), ("account_sid='AC1' ,]",)],
                          "value string").coalesce(1).write.text(path("log"))
    got = tables.read_response_log(spark, path("log")).collect()
    assert sorted((r.account_sid or "", r.country or "") for r in got) == [("", "Iran"), ("AC1", "")]


def test_countries_in_any_case_and_short(spark):
    text = "from italy, NIGERIA and Niger, the UK and USA; tell us of Guinea-Bissau or chadwick"
    assert tickets.ticket_fields(one(spark, text)).first().country == [
        "Guinea-Bissau", "Italy", "Niger", "Nigeria", "United Kingdom", "United States"]
    assert tickets.ticket_fields(one(spark, "in Foo"), ["Foo"]).first().country == ["Foo"]


#: ISO 3166 and Kosovo, written out here so that a gap in the table shows.
ISO_NAMES = """
    Afghanistan| Åland Islands| Albania| Algeria| American Samoa| Andorra| Angola| Anguilla|
    Antarctica| Antigua and Barbuda| Argentina| Armenia| Aruba| Australia| Austria| Azerbaijan|
    Bahamas| Bahrain| Bangladesh| Barbados| Belarus| Belgium| Belize| Benin| Bermuda| Bhutan|
    Bolivia| Bonaire, Sint Eustatius and Saba| Bosnia and Herzegovina| Botswana| Bouvet Island|
    Brazil| British Indian Ocean Territory| British Virgin Islands| Brunei Darussalam| Bulgaria|
    Burkina Faso| Burundi| Cabo Verde| Cambodia| Cameroon| Canada| Cayman Islands| Central
    African Republic| Chad| Chile| China| Christmas Island| Cocos (Keeling) Islands| Colombia|
    Comoros| Congo| Democratic Republic of the Congo| Cook Islands| Costa Rica| Côte d'Ivoire|
    Croatia| Cuba| Curaçao| Cyprus| Czechia| Denmark| Djibouti| Dominica| Dominican Republic|
    Ecuador| Egypt| El Salvador| Equatorial Guinea| Eritrea| Estonia| Eswatini| Ethiopia|
    Falkland Islands| Faroe Islands| Fiji| Finland| France| French Guiana| French Polynesia|
    French Southern Territories| Gabon| Gambia| Georgia| Germany| Ghana| Gibraltar| Greece|
    Greenland| Grenada| Guadeloupe| Guam| Guatemala| Guernsey| Guinea| Guinea-Bissau| Guyana|
    Haiti| Heard Island and McDonald Islands| Holy See| Honduras| Hong Kong| Hungary| Iceland|
    India| Indonesia| Iran| Iraq| Ireland| Isle of Man| Israel| Italy| Jamaica| Japan| Jersey|
    Jordan| Kazakhstan| Kenya| Kiribati| North Korea| South Korea| Kosovo| Kuwait| Kyrgyzstan|
    Laos| Latvia| Lebanon| Lesotho| Liberia| Libya| Liechtenstein| Lithuania| Luxembourg| Macao|
    Madagascar| Malawi| Malaysia| Maldives| Mali| Malta| Marshall Islands| Martinique|
    Mauritania| Mauritius| Mayotte| Mexico| Micronesia| Moldova| Monaco| Mongolia| Montenegro|
    Montserrat| Morocco| Mozambique| Myanmar| Namibia| Nauru| Nepal| Netherlands| New Caledonia|
    New Zealand| Nicaragua| Niger| Nigeria| Niue| Norfolk Island| North Macedonia| Northern
    Mariana Islands| Norway| Oman| Pakistan| Palau| Palestine| Panama| Papua New Guinea|
    Paraguay| Peru| Philippines| Pitcairn| Poland| Portugal| Puerto Rico| Qatar| Réunion|
    Romania| Russian Federation| Rwanda| Saint Barthélemy| Saint Helena| Saint Kitts and Nevis|
    Saint Lucia| Saint Martin| Saint Pierre and Miquelon| Saint Vincent and the Grenadines|
    Samoa| San Marino| Sao Tome and Principe| Saudi Arabia| Senegal| Serbia| Seychelles| Sierra
    Leone| Singapore| Sint Maarten| Slovakia| Slovenia| Solomon Islands| Somalia| South Africa|
    South Georgia and the South Sandwich Islands| South Sudan| Spain| Sri Lanka| Sudan|
    Suriname| Svalbard and Jan Mayen| Sweden| Switzerland| Syrian Arab Republic| Taiwan|
    Tajikistan| Tanzania| Thailand| Timor-Leste| Togo| Tokelau| Tonga| Trinidad and Tobago|
    Tunisia| Türkiye| Turkmenistan| Turks and Caicos Islands| Tuvalu| Uganda| Ukraine| United
    Arab Emirates| United Kingdom| United States Minor Outlying Islands| United States of
    America| Uruguay| Uzbekistan| Vanuatu| Venezuela| Viet Nam| US Virgin Islands| Wallis and
    Futuna| Western Sahara| Yemen| Zambia| Zimbabwe
"""


def test_all_iso_countries_are_found(spark):
    names = [" ".join(n.split()) for n in ISO_NAMES.split("|")]
    assert len(names) == 250
    rows = [(i, f"traffic to {n}, blocked", n) for i, n in enumerate([*names, *map(str.upper, names)])]
    got = {r.ticket_id: r.country for r in tickets.ticket_fields(spark.createDataFrame(
        rows, "ticket_id long, text string, n string")).collect()}
    short = [n for i, t, n in rows if not n.upper().startswith("US ") and len(got[i]) != 1]
    assert short == []
    assert len({c for found in got.values() for c in found}) == 250
    assert all(got[i] == got[i + 250] for i in range(250))


@pytest.mark.parametrize("text, mcc, mnc", [
    ("MCC: 310, 405 and MNC 260, 12", ["310", "405"], ["12", "260"]),
    ("mccs 310/405 & 222 or 208", ["208", "222", "310", "405"], []),
    ("MCC 310, then 405", ["310"], []), ("mnc=01 and 30450", [], ["01"]),
    ("MCC 310 and 9", ["310"], []), ("mcc: 310, mnc: 26", ["310"], ["26"])])
def test_lists_after_one_label(spark, text, mcc, mnc):
    got = tickets.ticket_fields(spark.createDataFrame([(1, text)], "ticket_id int, text string"))
    row = got.first()
    assert (row.mcc, row.mnc) == (mcc, mnc)


@pytest.mark.parametrize("text, found", [
    ("on 15 January 2024.", ["15 January 2024"]), ("Jan 15 or Feb 3, 2024",
                                                   ["Feb 3, 2024", "Jan 15"]),
    ("since the 3rd of May", ["3rd of May"]), ("January 15, we", ["January 15"]),
    ("in May 2024", ["May 2024"]), ("Sept 2023", ["Sept 2023"]), ("01/02/2024", ["01/02/2024"]),
    ("Mar was fine, Dec too", []), ("March", ["March"]), ("Janet 15", [])])
def test_forms_of_dates(spark, text, found):
    got = tickets.ticket_fields(spark.createDataFrame([(1, text)], "ticket_id int, text string"))
    assert got.first().date == found


def test_an_equal_country_list_is_the_same_list(spark):
    frame = spark.createDataFrame([(1, "From Burma to Guinea-Bissau, Guinea and guinea.")],
                                  "ticket_id int, text string")
    for names in (None, list(X.COUNTRIES)):
        assert tickets.ticket_fields(frame, names).first().country == [
            "Guinea", "Guinea-Bissau", "Myanmar"]


def test_the_tree_of_names_finds_what_an_alternation_does(spark):
    names = X.country_names()
    texts = [f"x {n}, {n.upper()} y" for n in names] + [
        "South Georgia and the South Sand", "Guinea-", "Nigeria Niger", "Dominican Republics"]
    plain = re.compile(r"\b(?:" + "|".join(sorted(map(re.escape, (
        n for n in names if n not in X.SHORT_COUNTRIES)), key=len, reverse=True)) + r")\b", re.I)
    frame = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = frame.select("text", X.every_match("text", X.country_pattern()).alias("m")).collect()
    for r in got:
        if r.text.isascii():
            assert r.m == plain.findall(r.text), r.text


def plain_labels(text, rows):
    low = text.lower()
    hit = {(place, label) for phrase, place, label in rows if (
        re.search(rf"\b{phrase}\b", low) if phrase.isdigit() else phrase.lower() in low)}
    return [label for _, label in sorted(hit)] or [X.OTHERS]


def test_a_lexicon_of_ten_thousand_phrases_in_one_pass(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcde") for _ in range(rng.randrange(2, 6)))
    phrases = {word() + rng.choice(("", " " + word(), "." + word())) for _ in range(14_000)}
    phrases |= {str(rng.randrange(10_000, 99_999)) for _ in range(500)}
    rows_ = [(p, n % 40, f"label {n % 40}") for n, p in enumerate(sorted(phrases))]
    assert len(rows_) > 10_000
    lexicon = spark.createDataFrame(rows_, "phrase string, place int, label string")
    some = [p for p, _, _ in rng.sample(rows_, 40)]
    texts = [" ".join(rng.sample(some, 2)).upper() + rng.choice(("", "x", " zzz")) for _ in range(30)]
    texts += ["", "zzz", "1234567", "say 12345x", None]
    frame = spark.createDataFrame(list(enumerate(texts)), "ticket_id int, text string")
    got = tickets.labels_by_lexicon(frame, lexicon, "labels")
    for r in got.collect():
        if r.text is not None:
            assert r.labels == plain_labels(r.text, rows_), r.text


def test_the_built_in_lexicon_as_a_table(spark):
    rows_ = [(p, k, label) for k, (label, ps) in enumerate(X.CATEGORY_PHRASES.items()) for p in ps]
    lexicon = spark.createDataFrame(rows_, "phrase string, place int, label string")
    texts = [f"my {p} is {q}!" for p, _, _ in rows_ for q, _, _ in rows_[::7]] + ["x30450 304501"]
    frame = spark.createDataFrame(list(enumerate(texts)), "ticket_id int, text string")
    plain = tickets.ticket_categories(frame).select("ticket_id", "categories")
    assert rows(tickets.labels_by_lexicon(frame, lexicon, "categories"), "ticket_id", "categories") \
        == rows(plain)


def test_each_prompt_is_asked_once(spark, path):
    asked = spark.sparkContext.accumulator(0)

    def model(prompts):
        asked.add(len(prompts))
        return prompts.str.upper()

    data = [("a",), ("b",), ("a",), (None,)] + [("hot",)] * 50
    first = spark.createDataFrame(data, "user_prompt string").repartition(5)
    second = first.union(spark.createDataFrame([("c",)], "user_prompt string"))
    for frame, n in ((first, 3), (second, 4)):
        got = scoring.score_new(frame, model, path("answers"), "m1")
        assert {(r.user_prompt, r.answer) for r in got.collect()} == {
            (p, p and p.upper()) for (p,) in frame.distinct().collect()}
        assert got.count() == frame.count() and asked.value == n
    scoring.score_new(first, model, path("answers"), "m2")
    assert asked.value == 7
