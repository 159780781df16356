"""Format-preserving pseudonyms for personal data, in built-in functions only.

Validated numbers and dates are permuted within their own format by a keyed
Feistel network: a card number becomes another number of that length with a
right check digit, a date another date, a phone number another with the same
prefix and punctuation. Equal values get equal pseudonyms in all documents
under one key, and different values of a format different ones.
"""

import pyspark.sql.functions as F

ROUNDS = 8

# What is looked for, in this order of preference.
EMAIL = (r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,255}+@[A-Za-z0-9][A-Za-z0-9.-]{0,253}"
         r"\.[A-Za-z]{2,24}(?![A-Za-z0-9])")
ADDRESS = r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?!\.?[0-9])"
ISO_DATE = r"(?<![0-9-])[0-9]{4}-[0-9]{2}-[0-9]{2}(?![0-9-])"
SLASH_DATE = r"(?<![0-9/])[0-9]{2}/[0-9]{2}/[0-9]{4}(?![0-9/])"
SOCIAL = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
PHONE = (r"(?<![0-9+])\+[0-9]{1,3}[ .-]?\(?[0-9]{2,4}\)?[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}(?![0-9])"
         r"|(?<![0-9+])\+[0-9]{1,3}[ .-]?\(?[0-9]{1,3}\)?(?:[ .-]?[0-9]{2}){4}(?![0-9])"
         r"|(?<![0-9+])\+[0-9]{1,3}[ .-]?\(?[0-9]{1,4}\)?(?:[ .-]?[0-9]{2,4}){2,4}(?![0-9])"
         r"|(?<![0-9+])(?:\([0-9]{3}\)[ .-]?|\(?[0-9]{3}[ .-])[0-9]{3}[ .-]?[0-9]{4}(?![0-9])")
#: Ten digits that stand alone; after cards, which may be written in such groups.
BARE = r"(?<![A-Za-z0-9+.])[2-9][0-9]{9}(?![A-Za-z0-9]|\.[0-9])"
#: Groups of digits up to where something else begins; the cards are looked for inside.
GROUPS = (r"(?<![0-9])(?=[0-9](?:[ -]?[0-9]){12})[0-9]++"
          rf"(?:[ -](?!{EMAIL}|{ADDRESS}|{ISO_DATE}|{SLASH_DATE}|{SOCIAL}|{PHONE})[0-9]++)*+")
KINDS = {"email": EMAIL, "address": ADDRESS, "date": f"{ISO_DATE}|{SLASH_DATE}",
         "social": SOCIAL, "phone": PHONE, "card": GROUPS, "bare": BARE}
#: First digits and lengths that card issuers use; such a number goes before other valid ones.
ISSUED = (r"^(?:4(?:[0-9]{12}|[0-9]{15}|[0-9]{18})|5[0-9]{15}|2[2-7][0-9]{14}|3[47][0-9]{13}"
          r"|3[068][0-9]{12}|35[0-9]{14}|6[0-9]{15,18})$")
#: All kinds but the first start with one of a few characters, so most places fail at one look.
NUMBERS = "(?=[0-9+(])(?:" + "|".join(p for k, p in KINDS.items() if k != "email") + ")"
ANY = f"{EMAIL}|{NUMBERS}"
LETTERS = "abcdefghijklmnopqrstuvwxyz"

#: Dates from 1900-01-01 on are numbered below 270 * 270; the last is 2099-08-05.
DATE_SIDE = 270


def _let(value, use):
    """``use(value)`` with the value computed once, however often it is named."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _digest(key, *parts):
    """Number of 60 bits from a keyed digest."""
    text = F.concat_ws("/", F.lit(key), *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("long")


def feistel(key, kind, left, right, a, b):
    """Permutation of pairs (left below ``a``, right below ``b``), as a struct (l, r)."""
    def step(s, i):
        even = i % 2 == 0
        other = F.when(even, s["r"]).otherwise(s["l"])
        noise = _digest(key, kind, a, b, i, other)
        return F.struct(
            F.when(even, (s["l"] + noise % a) % a).otherwise(s["l"]).alias("l"),
            F.when(even, s["r"]).otherwise((s["r"] + noise % b) % b).alias("r"))

    start = F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step)


def _pad(value, size):
    return F.lpad(value.cast("string"), size, "0")


def permuted_digits(key, kind, digits):
    """Another string of as many digits, for 2 to 36 of them."""
    size = F.length(digits)
    low = F.floor(size / 2).cast("int")
    high = size - low

    def power(n):
        return F.pow(F.lit(10.0), n).cast("long")

    network = feistel(key, kind, digits.substr(F.lit(1), low), digits.substr(low + 1, high),
                      power(low), power(high))
    return F.when(size < 2, digits).otherwise(_let(network, lambda s: F.concat(
        _pad(s["l"], low), _pad(s["r"], high))))


def _at(text, i):
    return text.substr(i.cast("int"), F.lit(1))


def _luhn_sum(digits):
    """Sum of digits, every second one from the right doubled, starting with the last but one."""
    size = F.length(digits)

    def add(total, i):
        def value(d):
            twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
            return F.when((size - i) % 2 == 1, twice).otherwise(d)

        return total + _let(_at(digits, i).cast("int"), value)

    return F.aggregate(F.sequence(F.lit(1), size), F.lit(0), add)


def _refill(shape, digits):
    """``shape`` with its digits replaced, from left to right, by ``digits``."""
    return _let(digits, lambda d: _refilled(shape, d))


def _refilled(shape, digits):
    places = F.sequence(F.lit(1), F.length(shape))
    filled = F.aggregate(places, F.struct(F.lit("").alias("t"), F.lit(0).alias("n")), lambda s, i: (
        F.when(_at(shape, i).rlike("[0-9]"), F.struct(
            F.concat(s["t"], _at(digits, s["n"] + 1)).alias("t"), (s["n"] + 1).alias("n")))
        .otherwise(F.struct(F.concat(s["t"], _at(shape, i)).alias("t"), s["n"].alias("n")))))
    return filled["t"]


def _digits(text):
    return F.regexp_replace(text, "[^0-9]", "")


def _email(key, text):
    """Letters to letters of the same case and digits to digits, half by half."""
    name = F.substring_index(text, "@", 1)
    size = F.length(name)
    low = F.ceil(size / 2).cast("int")

    def shifted(half, other, i):
        def move(c, at):
            noise = _digest(key, F.lit("email"), i, at, size, other)
            place = F.instr(F.lit(LETTERS), F.lower(c))
            letter = _at(F.lit(LETTERS), (place - 1 + noise % 26) % 26 + 1)
            return (F.when(place > 0, F.when(c == F.lower(c), letter).otherwise(F.upper(letter)))
                    .when(c.rlike("[0-9]"), ((c.cast("long") + noise % 10) % 10).cast("string"))
                    .otherwise(c))

        return F.array_join(F.transform(
            F.filter(F.split(half, ""), lambda c: c != ""), move), "")

    def step(s, i):
        even = i % 2 == 0
        return F.struct(
            F.when(even, shifted(s["l"], s["r"], i)).otherwise(s["l"]).alias("l"),
            F.when(even, s["r"]).otherwise(shifted(s["r"], s["l"], i)).alias("r"))

    start = F.struct(name.substr(F.lit(1), low).alias("l"),
                     name.substr(low + 1, F.greatest(size - low, F.lit(0))).alias("r"))
    network = F.aggregate(F.sequence(F.lit(0), F.lit(3)), start, step)
    return _let(network, lambda s: F.concat(s["l"], s["r"], F.substr(text, size + 1)))


def _address(key, text):
    part = F.split(text, "\\.")
    n = [part[i].cast("long") for i in range(4)]
    network = feistel(key, F.lit("address"), n[0] * 256 + n[1], n[2] * 256 + n[3],
                      F.lit(65536), F.lit(65536))
    new = _let(network, lambda s: F.concat_ws(".", *[x.cast("string") for x in (
        F.floor(s["l"] / 256), s["l"] % 256, F.floor(s["r"] / 256), s["r"] % 256)]))
    fits = F.greatest(*n) < 256
    return F.when(fits, new)


def _date(key, text):
    slash = text.contains("/")
    day = F.when(slash, F.try_to_timestamp(text, F.lit("MM/dd/yyyy"))).otherwise(
        F.try_to_timestamp(text, F.lit("yyyy-MM-dd")))
    day = F.coalesce(day, F.when(slash, F.try_to_timestamp(text, F.lit("dd/MM/yyyy")))).cast("date")
    number = F.datediff(day, F.lit("1900-01-01").cast("date"))
    side = F.lit(DATE_SIDE)
    network = feistel(key, F.lit("date"), F.floor(number / side), number % side, side, side)
    month_first = F.try_to_timestamp(text, F.lit("MM/dd/yyyy")).isNotNull()

    def shown(s):
        new = F.date_add(F.lit("1900-01-01").cast("date"), (s["l"] * side + s["r"]).cast("int"))
        return F.when(slash & month_first, F.date_format(new, "MM/dd/yyyy")).when(
            slash, F.date_format(new, "dd/MM/yyyy")).otherwise(F.date_format(new, "yyyy-MM-dd"))

    return F.when((number >= 0) & (number < DATE_SIDE * DATE_SIDE), _let(network, shown))


def _phone(key, text):
    """All digits but the country code, and nothing of fewer than 7."""
    head = F.regexp_extract(text, r"^(\+[0-9]{1,3}(?=[ .(-]))?", 1)
    rest = F.substr(text, F.length(head) + 1)
    digits = _digits(rest)
    return F.when(F.length(digits) >= 7, F.concat(
        head, _refill(rest, permuted_digits(key, F.lit("phone"), digits))))


def _social(key, text):
    digits = _digits(text)
    real = ~digits.rlike("^(000|666|9)|^...00|0000$")
    return F.when(real, _refill(text, permuted_digits(key, F.lit("social"), digits)))


def _card(key, text):
    digits = _digits(text)
    size = F.length(digits)
    body = permuted_digits(key, F.lit("card"), digits.substr(F.lit(1), size - 1))

    def checked(b):
        check = (10 - _luhn_sum(F.concat(b, F.lit("0"))) % 10) % 10
        return F.concat(b, check.cast("string"))

    return F.when(_let(digits, _luhn_sum) % 10 == 0, _refill(text, _let(body, checked)))


def _best(groups, k, issued):
    """How many groups from the ``k``-th on are a valid card, of 16 digits if one is; 0 if none."""
    def card(m):
        digits = F.array_join(F.slice(groups, k, m), "")
        size = F.length(digits)
        fits = size.between(13, 19)
        if issued:
            fits = fits & digits.rlike(ISSUED)
        return F.when(fits, F.when(_let(digits, _luhn_sum) % 10 == 0, F.struct(
            (size == 16).alias("usual"), size.alias("size"), m.alias("m"))))

    most = F.least(F.lit(19), F.size(groups) - k + 1)
    found = F.array_max(F.transform(F.sequence(F.lit(1), most), card))
    return F.coalesce(found["m"], F.lit(0))


def _cards(key, text):
    """Kinds and text of digit groups with all cards, and what then is left as a phone, replaced.

    From left to right; a valid number with no issuer's form gives way to one
    with it that begins inside.
    """
    def in_groups(groups):
        places = F.sequence(F.lit(1), F.size(groups))
        issued = F.transform(places, lambda k: _best(groups, k, True))
        return _let(issued, lambda own: F.aggregate(places, start, lambda s, k: step(
            groups, own, s, k), lambda s: F.struct(
            s["kinds"].alias("kinds"), s["value"].alias("value"))))

    def taken(groups, issued, k):
        def other(m):
            inside = F.exists(F.slice(issued, k + 1, F.greatest(m - 1, F.lit(0))), lambda x: x > 0)
            return F.when(inside, F.lit(0)).otherwise(m)

        own = F.element_at(issued, k)
        return F.when(own > 0, own).otherwise(_let(_best(groups, k, False), other))

    def step(groups, issued, s, k):
        def put(m):
            n = F.greatest(m, F.lit(1))
            size = F.length(F.array_join(F.slice(groups, k, n), "")) + n - 1
            old = text.substr(s["at"], size)
            phone = (m == 0) & old.rlike("^[2-9][0-9]{9}$")
            new = F.when(m > 0, _card(key, old)).when(phone, _phone(key, old)).otherwise(old)
            kind = F.when(m > 0, F.array(F.lit("card"))).when(phone, F.array(F.lit("phone")))
            return F.struct(
                (k + n).alias("next"), (s["at"] + size + 1).alias("at"),
                F.when(kind.isNull(), s["kinds"]).otherwise(F.concat(s["kinds"], kind)).alias("kinds"),
                F.concat(s["value"], new, text.substr(s["at"] + size, F.lit(1))).alias("value"))

        return F.when(k < s["next"], s).otherwise(_let(taken(groups, issued, k), put))

    start = F.struct(F.lit(1).alias("next"), F.lit(1).alias("at"),
                     F.array().cast("array<string>").alias("kinds"), F.lit("").alias("value"))
    return _let(F.regexp_extract_all(text, F.lit("[0-9]+"), F.lit(0)), in_groups)


def _replaced(key, value):
    """Kinds and new text of one match; no kinds where it holds no valid number or date."""
    makers = {"email": _email, "address": _address, "date": _date, "social": _social,
              "phone": _phone, "bare": _phone}

    def named(kind):
        return lambda new: F.struct(F.when(new.isNotNull(), F.array(F.lit(kind))).alias("kinds"),
                                    new.alias("value"))

    found = F.lit(None).cast("struct<kinds:array<string>,value:string>")
    for kind, pattern in reversed(KINDS.items()):
        if kind == "card":
            made = _cards(key, value)
        else:
            made = _let(makers[kind](key, value), named("phone" if kind == "bare" else kind))
        found = F.when(value.rlike(f"^(?:{pattern})$"), made).otherwise(found)
    return found


def pseudonymize(docs, key, text="text", out="text", counts="pii"):
    """``docs`` with personal data in ``text`` replaced under ``key``.

    ``out`` is the new text, ``counts`` a map from kind to the number of
    replaced values; columns of those names are replaced, all others stay as
    they are. What looks like a number but is not valid (a card whose check
    digit is wrong, an address above 255, a date that does not exist or lies
    before 1900 or after 2099-08-05) stays. In a row of digit groups every
    sub-row of 13 to 19 digits is tried as a card. Phones are numbers with a
    country code and ten digits with or without area brackets and separators. A null text stays null with an
    empty map; an empty text stays empty. Rows are independent of each other.
    """
    if not key:
        raise ValueError("a key is needed")
    source = F.col(text)
    # every kind holds a digit or an @, and most texts hold neither
    mail = source.contains("@")
    values = F.when(mail, F.regexp_extract_all(source, F.lit(f"({ANY})"), F.lit(1))).when(
        source.rlike("[0-9]"), F.regexp_extract_all(source, F.lit(f"({NUMBERS})"), F.lit(1)))
    between = F.when(mail, F.split(source, ANY, -1)).otherwise(F.split(source, NUMBERS, -1))
    pairs = F.transform(F.col("__values"), lambda v: F.struct(
        v.alias("old"), _replaced(key, v).alias("new")))
    pieces = F.zip_with(F.col("__between"), F.col("__pairs"), lambda b, p: F.concat(
        b, F.coalesce(p["new"]["value"], p["old"], F.lit(""))))
    kinds = F.flatten(F.transform(F.col("__pairs"), lambda p: F.coalesce(
        p["new"]["kinds"], F.array().cast("array<string>"))))
    counted = F.map_from_arrays(F.array_distinct(kinds), F.transform(
        F.array_distinct(kinds), lambda k: F.size(F.filter(kinds, lambda x: x == k))))
    has = F.size("__values") > 0
    none = F.create_map().cast("map<string,int>")
    renamed = docs.withColumn("__values", F.coalesce(values, F.array().cast("array<string>")))
    renamed = renamed.withColumn("__between", F.when(has, between))
    renamed = renamed.withColumn("__pairs", F.when(has, pairs))
    return renamed.withColumns({
        out: F.when(has, F.array_join(pieces, "")).otherwise(source),
        counts: F.when(has, counted).otherwise(none),
    }).drop("__values", "__between", "__pairs")
