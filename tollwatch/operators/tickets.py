"""Triage of help tickets in batch; all rules are exact and repeatable.

Every operator but the transcripts is a projection over ``(ticket_id, text, …)``: no shuffle, and
the rule tables are part of the plan rather than something to join.
"""

from pyspark.sql import functions as F

from tollwatch.functions import text as X
from tollwatch.functions.columns import col
from tollwatch.operators.ordered import position_within

# Answers per category; one text may serve several categories.
_UNDER_REVIEW = "We are looking into the issue; the fraud data team will follow up."
_MEANWHILE = ("Meanwhile please use the safe list, or the risk check parameter, to avoid "
              "blocking genuine messages.")
REPLIES = {
    "Enablement": "Please see the account page for the modes and when they were enabled.",
    "SafeList": "Please use the safe list API to add or remove numbers.",
    "Risk Check": "Please use the risk check parameter as described in the documentation.",
    "False Negative": _UNDER_REVIEW,
    "False Positive": f"{_UNDER_REVIEW} {_MEANWHILE}",
    "Refund": "Please send refund questions to the credit memo team.",
    "Billing": "Please send billing questions to the credit memo team.",
    "60410": f"{_UNDER_REVIEW} {_MEANWHILE}",
    "30450": f"{_UNDER_REVIEW} {_MEANWHILE}",
    "30453": f"{_UNDER_REVIEW} {_MEANWHILE}",
}
ASK_ACCOUNT = "Please give the account id the issue is about."
ASK_DETAIL = "Please describe the issue in a little more detail."
HELP, DETAILS, GENERAL = "help_request", "account_details", "general_chat"


def ticket_fields(tickets, countries=None):
    """Account id, codes, dates and countries named in the text."""
    pairs = tickets.withColumn("mcc_mnc", X.carrier_pairs("text"))
    return (
        pairs.withColumn("account_sid", X.account_id("text"))
        .withColumn("country", X.countries("text", countries or X.COUNTRIES))
        .withColumn("mcc", X.mccs("text", F.col("mcc_mnc")))
        .withColumn("mnc", X.mncs("text", F.col("mcc_mnc")))
        .withColumn("date", X.dates("text"))
        .withColumn("error_code", X.error_codes("text"))
    )


def with_labels(df, text, name, words_by_label):
    """Add the labels found in a text.

    The lower-case text is a column of its own: as part of every word test it
    would be computed once per word.
    """
    lowered = df.withColumn("_lower", F.lower(col(text)))
    return lowered.withColumn(name, X.labels_found("_lower", words_by_label)).drop("_lower")


def ticket_products(tickets, text="text"):
    return with_labels(tickets, text, "products", X.PRODUCT_WORDS)


def ticket_categories(tickets, text="text", name="categories", phrases=None):
    """Categories found in the text; ``Others`` when there is none."""
    found = with_labels(tickets, text, "_labels", phrases or X.CATEGORY_PHRASES)
    some = F.when(F.size("_labels") > 0, F.col("_labels")).otherwise(F.array(F.lit(X.OTHERS)))
    return found.withColumn(name, some).drop("_labels")


#: Phrases that fit into one pattern.
LEXICON_PHRASES = 100_000


def labels_by_lexicon(tickets, lexicon, name, text="text", default=X.OTHERS):
    """Labels of all phrases of a lexicon table found in the text, in one pass over it.

    ``lexicon`` has label, place (the order of the labels) and phrase. The rules
    are those of ``ticket_categories``: letter case does not count, a phrase may
    stand inside a word, and a phrase of digits only counts where it stands
    alone. ``default`` is the only label of a text without any. The phrases
    become one pattern on the driver, at most ``LEXICON_PHRASES`` of them.
    """
    rows = lexicon.where(F.length("phrase") > 0).select(
        F.lower("phrase").alias("phrase"), "place", "label").distinct()
    rows = [tuple(r) for r in rows.limit(LEXICON_PHRASES + 1).collect()]
    if len(rows) > LEXICON_PHRASES:
        raise ValueError(f"a lexicon may have {LEXICON_PHRASES} phrases at most")
    lowered = tickets.withColumn("_lower", F.lower(col(text)))
    found = X.lexicon_labels("_lower", rows)
    none = F.array(F.lit(default)) if default is not None else F.array().cast("array<string>")
    return lowered.withColumn(name, F.when(F.size(found) > 0, found).otherwise(none)).drop("_lower")


def account_id_check(df, account="account_sid"):
    return (df.withColumn("is_account_id", X.account_id_loose(account))
            .withColumn("is_full_account_id", X.account_id_strict(account)))


def ticket_summary(triaged):
    """Short extract of what was found; absent parts are left out."""
    def part(label, array):
        joined = F.array_join(array, ", ")
        return F.when(F.size(array) > 0, F.concat(F.lit(label), joined))

    return triaged.withColumn("summary", F.concat_ws(
        "; ",
        F.concat(F.lit("account: "), F.col("account_sid")),
        part("country: ", F.col("country")),
        part("product: ", F.col("products")),
        part("issue: ", F.col("categories")),
    ))


def ticket_reply(triaged, account="account_sid", categories="categories"):
    """Answers to the categories found, and questions for what is missing."""
    pairs = [F.lit(x) for pair in REPLIES.items() for x in pair]
    table = F.create_map(*pairs)
    found = F.coalesce(col(categories), F.array())
    answers = F.array_distinct(F.array_compact(
        F.transform(found, lambda c: F.try_element_at(table, c))))
    vague = (F.size(found) == 0) | F.array_contains(found, X.OTHERS)
    no_account = ~X.account_id_loose(account)
    return triaged.withColumn("reply", F.concat_ws(
        "\n",
        F.when(F.size(answers) > 0, F.array_join(answers, "\n")),
        F.when(no_account, ASK_ACCOUNT),
        F.when(vague, ASK_DETAIL),
    ))


def issue_details(df, account="account_sid", products="products", category="category",
                  reason="reason"):
    """Numbered restatement of account, product and issue."""
    account_line = F.when(X.account_id_loose(account),
                          F.concat(F.lit("Account: "), col(account))).otherwise(ASK_ACCOUNT)
    product_line = F.when(F.size(col(products)) > 0, F.concat(
        F.lit("Product: "), F.array_join(col(products), ", "))).otherwise(
        "Please say which product is affected.")
    issue_line = F.when(col(category).isNull(), ASK_DETAIL).otherwise(F.concat(
        F.lit("Issue: "), col(category), F.lit("; reason: "),
        F.coalesce(col(reason), F.lit("not given"))))
    return df.withColumn("details", F.concat(
        F.lit("1. "), account_line, F.lit("\n2. "), product_line,
        F.lit("\n3. "), issue_line))


def parse_responses(df, record, response="response"):
    """Fields of a JSON response, and whether it holds all of them with the right types.

    Text before a closing think tag is dropped, and so is what stands around
    the outermost braces, such as a lead-in sentence or a code fence. Field
    names are taken in any letter case.
    """
    body = X.braced(X.after_thinking(response))
    for name in record.fieldNames():
        body = F.regexp_replace(body, rf'(?i)"{name}"\s*:', f'"{name}":')
    fields = record.fieldNames()
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in record.fields)
    parsed = F.from_json(body, f"{schema}, _corrupt_record string")
    valid = F.col("_parsed._corrupt_record").isNull()
    for name in fields:
        valid = valid & F.col(f"_parsed.{name}").isNotNull()
    return (df.withColumn("_parsed", parsed)
            .withColumn("is_valid", F.coalesce(valid, F.lit(False)))
            .select(*df.columns, "is_valid", *[F.when(F.col("is_valid"), F.col(f"_parsed.{f}"))
                                               .alias(f) for f in fields]))


def accepted(parsed):
    return parsed.where("is_valid").drop("is_valid")


def rejected(parsed, response="response"):
    return parsed.where("not is_valid").select("ticket_id", response)


def route_messages(messages, first_turn=0):
    """Where each message goes: help request, details of the last request, or chat.

    Anything with an account id or a triage keyword is a help request, also
    when it starts like a confirmation. A confirmation needs an earlier turn.
    """
    lowered = F.col("_lower")
    words = [w for table in (X.PRODUCT_WORDS, X.CATEGORY_PHRASES) for ws in table.values()
             for w in ws]
    help_request = X.account_id("text").isNotNull() | X.contains_any(
        lowered, sorted({*words, *X.HELP_WORDS}))
    confirms = F.regexp_like(
        lowered, F.lit(r"^\s*(?:" + "|".join(X.CONFIRM_WORDS) + r")\b"))
    return messages.withColumn("_lower", F.lower("text")).withColumn(
        "route",
        F.when(help_request, HELP)
        .when(confirms & (F.col("turn") > first_turn), DETAILS)
        .otherwise(GENERAL)).drop("_lower")


def transcript(messages, turns_per_page=100):
    """Messages as ``role: text`` in turn order, in pages of ``turns_per_page`` messages.

    Pages go by the place of a message in its conversation, so that no page
    has more messages, whatever their turn numbers are; messages of one turn
    come by role and text.
    """
    placed = position_within(messages.select("conv_id", "turn", "role", "text"), ["conv_id"],
                             ["turn", "role", "text"], "_place")
    page = F.floor(F.col("_place") / turns_per_page).cast("long")
    lines = F.array_sort(F.collect_list(F.struct("_place", "role", "text")))
    written = F.transform(lines, lambda m: _line(m["role"], m["text"]))
    return placed.groupBy("conv_id", page.alias("page")).agg(
        F.array_join(written, "\n").alias("transcript"))


def transcript_lines(messages):
    """One line per message in conversation order."""
    line = _line(F.col("role"), F.col("text"))
    return messages.select("conv_id", "turn", line.alias("line")).orderBy("conv_id", "turn")


def _line(role, text):
    """A message without role or text keeps its line."""
    return F.concat(F.coalesce(role, F.lit("")), F.lit(": "), F.coalesce(text, F.lit("")))


def render_prompts(tickets, system_text, text="text"):
    """System and user text of each ticket for a model call."""
    return (tickets.withColumn("system_prompt", F.lit(system_text))
            .withColumn("user_prompt", F.concat(F.lit("Query : "), F.trim(col(text)))))
