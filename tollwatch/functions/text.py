"""Text rules for help tickets as column expressions.

Word lists are fixed values. Matching is on lower case and by substring, all
inside one narrow stage.
"""

from functools import reduce

from pyspark.sql import functions as F

from tollwatch.functions.columns import col

OTHERS = "Others"

# Product keywords.
PRODUCT_WORDS = {
    "Fraud Guard": ["verify", "fraud guard", "standard mode", "max mode", "basic mode", "60410"],
    "SMS PP": ["30450", "api.dsg.smspumpingprotection.enable", "pumping protection",
               "programmable sms", "sms pp"],
    "Shadow Mode": ["30453", "api.dsg.smspumpingprotection.shadowmode", "shadow mode"],
    "Algo mode": ["api.dsg.algomode"],
}

# Issue categories and the phrases read as them.
CATEGORY_PHRASES = {
    "Enablement": ["enablement", "mode settings", "mode enabled", "history of modes"],
    "SafeList": ["safelist", "adding numbers", "removing numbers"],
    "Risk Check": ["risk check", "riskcheck"],
    "False Negative": ["missed fraud", "low conversion rate", "high volume of messages"],
    "False Positive": ["genuine messages blocked", "blocked messages"],
    "Refund": ["credit memo", "refund"],
    "Billing": ["pricing", "billing"],
    "60410": ["60410", "unblocking 30453"],
    "30450": ["30450"],
    "30453": ["30453"],
}

# A summary names categories by their labels, so there these count as phrases too.
SUMMARY_PHRASES = {label: [*dict.fromkeys([*words, label.lower()])]
                   for label, words in CATEGORY_PHRASES.items()}

# Keywords that decode a product answer, first match wins.
PRODUCT_DECODING = [
    ("Fraud Guard", ["1", "fraud guard", "fg", "guard", "fraud", "fraudguard", "verify"]),
    ("SMS PP", ["2", "sms pp", "pp", "pumping", "sms", "sms pumping protection"]),
    ("Shadow mode", ["3", "shadow mode", "shadow", "shadowmode"]),
    ("Algo mode", ["4", "algo mode", "algo", "algomode"]),
]

# Keywords that decode an issue answer, first match wins.
ISSUE_DECODING = [
    ("Enablement related",
     ["1", "enablement", "date of enablement", "mode enabled", "history of modes"]),
    ("Add/delete numbers to/from safelist", ["2", "add", "delete", "numbers", "safelist"]),
    ("Missed detecting fraud", ["3", "missed", "detecting", "fraud"]),
    ("Blocked genuine messages or customers",
     ["4", "blocked", "genuine", "messages", "customers"]),
    ("Requesting Credit Memo Or refund for missed fraud",
     ["5", "requesting", "credit memo", "refund", "missed fraud"]),
    ("Pricing or billind related issue", ["9", "pricing", "billind", "related issue"]),
    ("Off boarding request & refund of SMS PP charges",
     ["10", "off boarding", "refund", "sms pp", "charges"]),
    ("High volume of 30450 detected", ["11", "high volume", "30450", "detected"]),
    ("Add numbers to safelist, Problems with adding numbers to safelist",
     ["12", "add numbers", "safelist", "problems", "adding numbers"]),
    ("How to enable riskcheck, risk check related issue.",
     ["13", "how to enable", "riskcheck", "risk check", "related issue"]),
    ("Unblocking of 30453 filtering & refund request for blocked messages",
     ["14", "unblocking", "30453", "filtering", "refund request", "blocked messages"]),
    ("High volume of 30453 detected", ["15", "high volume", "30453", "detected"]),
]

# Country names, looked for in any letter case unless the caller names others,
# and short forms, looked for as they stand.
COUNTRIES = [
    "Afghanistan", "Åland Islands", "Albania", "Algeria", "American Samoa", "Andorra", "Angola",
    "Anguilla", "Antarctica", "Antigua and Barbuda", "Argentina", "Armenia", "Aruba", "Australia",
    "Austria", "Azerbaijan", "Bahamas", "Bahrain", "Bangladesh", "Barbados", "Belarus", "Belgium",
    "Belize", "Benin", "Bermuda", "Bhutan", "Bolivia", "Bonaire, Sint Eustatius and Saba",
    "Bosnia and Herzegovina", "Botswana", "Bouvet Island", "Brazil",
    "British Indian Ocean Territory", "British Virgin Islands", "Brunei", "Bulgaria",
    "Burkina Faso", "Burundi", "Cambodia", "Cameroon", "Canada", "Cape Verde", "Cayman Islands",
    "Central African Republic", "Chad", "Chile", "China", "Christmas Island", "Cocos Islands",
    "Colombia", "Comoros", "Congo", "Cook Islands", "Costa Rica", "Croatia", "Cuba", "Curaçao",
    "Cyprus", "Czechia", "Democratic Republic of the Congo", "Denmark", "Djibouti", "Dominica",
    "Dominican Republic", "Ecuador", "Egypt", "El Salvador", "Equatorial Guinea", "Eritrea",
    "Estonia", "Eswatini", "Ethiopia", "Falkland Islands", "Faroe Islands", "Fiji", "Finland",
    "France", "French Guiana", "French Polynesia", "French Southern Territories", "Gabon",
    "Gambia", "Georgia", "Germany", "Ghana", "Gibraltar", "Greece", "Greenland", "Grenada",
    "Guadeloupe", "Guam", "Guatemala", "Guernsey", "Guinea", "Guinea-Bissau", "Guyana", "Haiti",
    "Heard Island and McDonald Islands", "Honduras", "Hong Kong", "Hungary", "Iceland", "India",
    "Indonesia", "Iran", "Iraq", "Ireland", "Isle of Man", "Israel", "Italy", "Ivory Coast",
    "Jamaica", "Japan", "Jersey", "Jordan", "Kazakhstan", "Kenya", "Kiribati", "Kosovo", "Kuwait",
    "Kyrgyzstan", "Laos", "Latvia", "Lebanon", "Lesotho", "Liberia", "Libya", "Liechtenstein",
    "Lithuania", "Luxembourg", "Macau", "Madagascar", "Malawi", "Malaysia", "Maldives", "Mali",
    "Malta", "Marshall Islands", "Martinique", "Mauritania", "Mauritius", "Mayotte", "Mexico",
    "Micronesia", "Moldova", "Monaco", "Mongolia", "Montenegro", "Montserrat", "Morocco",
    "Mozambique", "Myanmar", "Namibia", "Nauru", "Nepal", "Netherlands", "New Caledonia",
    "New Zealand", "Nicaragua", "Niger", "Nigeria", "Niue", "Norfolk Island", "North Korea",
    "North Macedonia", "Northern Mariana Islands", "Norway", "Oman", "Pakistan", "Palau",
    "Palestine", "Panama", "Papua New Guinea", "Paraguay", "Peru", "Philippines", "Pitcairn",
    "Poland", "Portugal", "Puerto Rico", "Qatar", "Romania", "Russia", "Rwanda", "Réunion",
    "Saint Barthélemy", "Saint Helena", "Saint Kitts and Nevis", "Saint Lucia", "Saint Martin",
    "Saint Pierre and Miquelon", "Saint Vincent and the Grenadines", "Samoa", "San Marino",
    "Sao Tome and Principe", "Saudi Arabia", "Senegal", "Serbia", "Seychelles", "Sierra Leone",
    "Singapore", "Sint Maarten", "Slovakia", "Slovenia", "Solomon Islands", "Somalia",
    "South Africa", "South Georgia and the South Sandwich Islands", "South Korea", "South Sudan",
    "Spain", "Sri Lanka", "Sudan", "Suriname", "Svalbard and Jan Mayen", "Sweden", "Switzerland",
    "Syria", "Taiwan", "Tajikistan", "Tanzania", "Thailand", "Timor-Leste", "Togo", "Tokelau",
    "Tonga", "Trinidad and Tobago", "Tunisia", "Turkey", "Turkmenistan",
    "Turks and Caicos Islands", "Tuvalu", "US Virgin Islands", "Uganda", "Ukraine",
    "United Arab Emirates", "United Kingdom", "United States",
    "United States Minor Outlying Islands", "Uruguay", "Uzbekistan", "Vanuatu", "Vatican City",
    "Venezuela", "Vietnam", "Wallis and Futuna", "Western Sahara", "Yemen", "Zambia", "Zimbabwe",
]
# Other spellings and former names, looked for unless the caller names countries.
OTHER_NAMES = {
    "Aland Islands": "Åland Islands", "Antigua & Barbuda": "Antigua and Barbuda",
    "Barbuda": "Antigua and Barbuda", "Bonaire": "Bonaire, Sint Eustatius and Saba",
    "Bosnia": "Bosnia and Herzegovina", "Bosnia & Herzegovina": "Bosnia and Herzegovina",
    "Brunei Darussalam": "Brunei", "Burma": "Myanmar", "Cabo Verde": "Cape Verde",
    "Cocos (Keeling) Islands": "Cocos Islands", "Congo-Brazzaville": "Congo",
    "Congo-Kinshasa": "Democratic Republic of the Congo", "Cote d'Ivoire": "Ivory Coast",
    "Curacao": "Curaçao", "Czech Republic": "Czechia", "Côte d'Ivoire": "Ivory Coast",
    "Côte d’Ivoire": "Ivory Coast", "DR Congo": "Democratic Republic of the Congo",
    "Democratic People's Republic of Korea": "North Korea",
    "Democratic Republic of Congo": "Democratic Republic of the Congo",
    "East Timor": "Timor-Leste", "Faeroe Islands": "Faroe Islands",
    "Federated States of Micronesia": "Micronesia", "Great Britain": "United Kingdom",
    "Holy See": "Vatican City", "Hongkong": "Hong Kong", "Jan Mayen": "Svalbard and Jan Mayen",
    "Keeling Islands": "Cocos Islands", "La Réunion": "Réunion",
    "Lao People's Democratic Republic": "Laos", "Macao": "Macau", "Macedonia": "North Macedonia",
    "Malvinas": "Falkland Islands", "Northern Ireland": "United Kingdom",
    "Palestinian Territories": "Palestine", "Palestinian Territory": "Palestine",
    "Pitcairn Islands": "Pitcairn", "Republic of Korea": "South Korea",
    "Republic of Moldova": "Moldova", "Republic of the Congo": "Congo", "Reunion": "Réunion",
    "Russian Federation": "Russia", "Saint Barthelemy": "Saint Barthélemy",
    "Saint Kitts": "Saint Kitts and Nevis", "Sao Tome": "Sao Tome and Principe",
    "Sint Eustatius": "Bonaire, Sint Eustatius and Saba",
    "South Georgia": "South Georgia and the South Sandwich Islands",
    "South Sandwich Islands": "South Georgia and the South Sandwich Islands",
    "St Barthelemy": "Saint Barthélemy", "St Helena": "Saint Helena",
    "St Kitts and Nevis": "Saint Kitts and Nevis", "St Lucia": "Saint Lucia",
    "St Maarten": "Sint Maarten", "St Martin": "Saint Martin",
    "St Pierre and Miquelon": "Saint Pierre and Miquelon",
    "St Vincent and the Grenadines": "Saint Vincent and the Grenadines",
    "St. Barthelemy": "Saint Barthélemy", "St. Barts": "Saint Barthélemy",
    "St. Helena": "Saint Helena", "St. Kitts": "Saint Kitts and Nevis",
    "St. Kitts and Nevis": "Saint Kitts and Nevis", "St. Lucia": "Saint Lucia",
    "St. Maarten": "Sint Maarten", "St. Martin": "Saint Martin",
    "St. Pierre and Miquelon": "Saint Pierre and Miquelon",
    "St. Vincent and the Grenadines": "Saint Vincent and the Grenadines",
    "Svalbard": "Svalbard and Jan Mayen", "Swaziland": "Eswatini",
    "Syrian Arab Republic": "Syria", "São Tomé": "Sao Tome and Principe",
    "São Tomé and Príncipe": "Sao Tome and Principe", "The Gambia": "Gambia",
    "Timor Leste": "Timor-Leste", "Tobago": "Trinidad and Tobago",
    "Trinidad": "Trinidad and Tobago", "Trinidad & Tobago": "Trinidad and Tobago",
    "Turkiye": "Turkey", "Turks and Caicos": "Turks and Caicos Islands", "Türkiye": "Turkey",
    "U.S. Virgin Islands": "US Virgin Islands",
    "United States Virgin Islands": "US Virgin Islands",
    "United States of America": "United States", "Vatican": "Vatican City", "Viet Nam": "Vietnam",
    "Virgin Islands, British": "British Virgin Islands",
    
}
SHORT_COUNTRIES = {"UK": "United Kingdom", "USA": "United States", "US": "United States",
                   "UAE": "United Arab Emirates", "DRC": "Democratic Republic of the Congo"}

# Opening words that confirm the last message.
CONFIRM_WORDS = ["yes", "correct", "confirm", "confirmed", "right", "agreed"]
# Words that make a message a help request besides products and categories.
HELP_WORDS = ["account sid", "error code", "fraud", "blocked", "safelist"]

# Patterns, each with the characters a match may start with.
ACCOUNT_ID = "A", r"\bAC[0-9A-Za-z]*[0-9][0-9A-Za-z]*"
DASHED_NUMBERS = "0-9", r"\b[0-9]+(?:-[0-9]+)+\b"
# A label and the codes listed after it, such as ``MCC: 310, 405 and 222``; a dashed number
# ends the list.
_STEP, _ENDS = "(?: ?, ?| ?/ ?| and | & | or )", r"\b(?!-[0-9])"
_MCC, _MNC = f"[2-7][0-9]{{2}}{_ENDS}", f"[0-9]{{2,3}}{_ENDS}"
NAMED_MCC = "Mm", rf"\b[Mm][Cc][Cc][Ss]?[ :=]+({_MCC}(?:{_STEP}{_MCC})*)"
NAMED_MNC = "Mm", rf"\b[Mm][Nn][Cc][Ss]?[ :=]+({_MNC}(?:{_STEP}{_MNC})*)"
ERROR_CODE = "0-9", r"\b[0-9]{5}\b"
# A full month stands for itself, a short one needs a day or year beside it.
MONTH = ("January|February|March|April|May|June|July|August|September|October|November|December")
SHORT_MONTH = "Jan|Feb|Mar|Apr|Jun|Jul|Aug|Sept|Sep|Oct|Nov|Dec"
_DAY = "[0-9]{1,2}(?:st|nd|rd|th)?"
DATE_TEXT = "ADFJMNOS0-9", (
    rf"\b{_DAY} (?:of )?(?:{MONTH}|{SHORT_MONTH})\b(?:,? [0-9]{{4}}\b)?"
    rf"|\b(?:{MONTH})(?: {_DAY},?)?(?: [0-9]{{4}})?\b"
    rf"|\b(?:{SHORT_MONTH}) (?:{_DAY}(?:,? [0-9]{{4}})?|[0-9]{{4}})\b"
    r"|\b[0-9]{4}-[0-9]{2}-[0-9]{2}\b|\b[0-9]{1,2}/[0-9]{1,2}/(?:[0-9]{4}|[0-9]{2})\b"
)
CARRIER_PAIR = r"^[2-7][0-9]{2}-[0-9]{2,3}$"


def _any_case(character):
    """Pattern of one character inside ``(?i:)``, which folds ASCII letters only in Java."""
    if character.isalpha() and not character.isascii():
        return f"[{character.lower()}{character.upper()}]"
    return f"[{character}]" if character in ".()" else character


def letter_tree(phrases, letter=_any_case):
    """Pattern of any of the phrases, as a tree of their letters, longer ones first."""
    tree = {}
    for phrase in phrases:
        at = tree
        for character in phrase:
            at = at.setdefault(letter(character), {})
        at[""] = {}

    def rendered(node):
        tries = [c + rendered(below) for c, below in sorted(node.items()) if c]
        if not tries:
            return ""
        joined = tries[0] if len(tries) == 1 and "" not in node else f"(?:{'|'.join(tries)})"
        return joined + "?" * ("" in node)

    return rendered(tree)


def country_pattern(names=COUNTRIES):
    """Any of the names, so that a word of the text is read once."""
    names = [n.lower() for n in _with_other_names(names)]
    letters = "".join(sorted({n[0] for n in names}))
    return letters + letters.upper(), rf"\b(?i:{letter_tree(names)})\b"


def _literal(character):
    return character if character.isalnum() or character == " " else f"\\{character}"


def lexicon_labels(lowered, rows):
    """Labels of phrases (phrase, place, label) found in a lower-case text, by place.

    At each position the longest phrase is taken; the others that start there
    are its beginnings, and their labels come with it.
    """
    codes = {p for p, _, _ in rows if p.isdigit()}
    by_phrase = {}
    for phrase, place, label in rows:
        by_phrase.setdefault(phrase, set()).add((place, label))
    found = []
    for own, pattern in ((codes, r"\b({})\b"), (set(by_phrase) - codes, "(?=({}))")):
        if not own:
            continue
        table = {}
        for phrase in sorted(own):
            starts = [phrase] if own is codes else [
                phrase[:n] for n in range(1, len(phrase) + 1) if phrase[:n] in own]
            places = sorted({place for p in starts for place, _ in by_phrase[p]})
            table[phrase] = ",".join(map(str, places))
        hits = F.array_distinct(F.regexp_extract_all(
            col(lowered), F.lit(pattern.format(letter_tree(sorted(own), _literal))), 1))
        found.append(_looked_up(hits, table))
    names = {place: label for _, place, label in rows}
    order = F.create_map(*[F.lit(x) for pair in sorted(names.items()) for x in pair])
    all_places = sorted_set(F.concat(*found)) if found else F.array().cast("array<int>")
    return F.transform(all_places, lambda p: F.try_element_at(order, p))


def _looked_up(hits, table):
    """Numbers that the table lists for each hit, in one array."""
    known = F.map_from_arrays(F.lit(list(table)), F.lit(list(table.values())))
    listed = F.array_join(F.transform(hits, lambda hit: F.try_element_at(known, hit)), ",")
    return F.when(listed != "", F.split(listed, ",").cast("array<int>")).otherwise(
        F.array().cast("array<int>"))


def _with_other_names(names):
    return {**{n: n for n in names}, **(OTHER_NAMES if list(names) == COUNTRIES else {})}


SHORT_COUNTRY = "UD", r"\b(?:" + "|".join(SHORT_COUNTRIES) + r")\b"


def country_names(names=COUNTRIES):
    """Name or other name in lower case, or short form, to name."""
    return {**{k.lower(): n for k, n in _with_other_names(names).items()}, **SHORT_COUNTRIES}


def quick(pattern):
    """The pattern behind a look at the first character.

    Most positions of a text fail on that one look, before any boundary test or
    alternative is tried.
    """
    first, rest = pattern
    return F.lit(f"(?=[{first}])(?:{rest})")


def contains_any(lowered, words):
    return reduce(lambda a, b: a | b, [lowered.contains(w) for w in words])


def every_match(c, pattern, group=0):
    return F.regexp_extract_all(col(c), quick(pattern), group)


def sorted_set(array):
    return F.array_sort(F.array_distinct(array))


def account_id(text):
    """First account id, null when there is none."""
    return F.nullif(F.regexp_substr(col(text), quick(ACCOUNT_ID)), F.lit(""))


def carrier_pairs(text):
    """Country-carrier pairs; longer dashed numbers such as dates and phones are none."""
    return sorted_set(F.filter(
        every_match(text, DASHED_NUMBERS), lambda x: x.rlike(CARRIER_PAIR)))


def _listed(text, pattern):
    """Codes of all lists that follow a label."""
    lists = every_match(text, pattern, 1)
    return F.flatten(F.transform(lists, lambda x: F.split(x, "[^0-9]+")))


def mccs(text, pairs):
    return sorted_set(F.concat(
        F.transform(pairs, lambda x: F.substring_index(x, "-", 1)), _listed(text, NAMED_MCC)))


def mncs(text, pairs):
    return sorted_set(F.concat(
        F.transform(pairs, lambda x: F.substring_index(x, "-", -1)), _listed(text, NAMED_MNC)))


def error_codes(text):
    return sorted_set(every_match(text, ERROR_CODE))


def dates(text):
    return sorted_set(every_match(text, DATE_TEXT))


def countries(text, names=COUNTRIES):
    """Countries named, spelled as in ``names``."""
    table = F.create_map(*[F.lit(x) for pair in country_names(names).items() for x in pair])
    found = F.concat(F.transform(every_match(text, country_pattern(names)), F.lower),
                     every_match(text, SHORT_COUNTRY))
    return sorted_set(F.transform(found, lambda x: F.try_element_at(table, x)))


def names_any(lowered, words):
    """Whether a text holds any of the words; a code counts only where it stands alone."""
    codes = [w for w in words if w.isdigit()]
    tests = [contains_any(lowered, plain)] if (plain := [w for w in words if w not in codes]) else []
    if codes:
        tests.append(lowered.rlike(r"\b(?:" + "|".join(codes) + r")\b"))
    return reduce(lambda a, b: a | b, tests)


def labels_found(lowered, words_by_label):
    """Labels with any of their words in a lower-case text, in the order of the table."""
    hits = [F.when(names_any(col(lowered), words), F.lit(label))
            for label, words in words_by_label.items()]
    return F.array_compact(F.array(*hits))


def first_decoding(lowered, branches, default=None):
    """Label of the first branch with a word in the lower-case text."""
    chain = F
    for label, words in branches:
        chain = chain.when(contains_any(lowered, words), label)
    return chain if default is None else chain.otherwise(default)


def decode_products(answers):
    """Decoded products of an array of answers; unmatched ones go, repeats stay."""
    lowered = F.transform(col(answers), F.lower)
    return F.array_compact(F.transform(
        lowered, lambda answer: first_decoding(answer, PRODUCT_DECODING)))


def decode_issue(answer):
    return first_decoding(F.lower(col(answer)), ISSUE_DECODING, OTHERS)


def account_id_loose(account):
    return F.coalesce(col(account).startswith("AC"), F.lit(False))


def account_id_strict(account):
    return account_id_loose(account) & (F.length(col(account)) == 34)


def braced(body):
    """From the first opening to the last closing brace; the whole text without them."""
    found = F.regexp_substr(body, F.lit(r"(?s)\{.*\}"))
    return F.coalesce(found, body)


def after_thinking(response, tag="</think>"):
    """What follows the think block; the whole response when there is none."""
    return F.coalesce(F.try_element_at(F.split(col(response), tag), F.lit(2)), col(response))
