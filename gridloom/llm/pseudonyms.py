"""PII pseudonyms: validated numbers and dates (and the local parts of addresses) are permuted within their
format by a keyed Feistel network, so equal values get equal pseudonyms in every document and different
values different ones.

Only DataFrame functions are used: one regular expression finds candidates, checks decide which are real,
and the network is an expression over two integers.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
#: Characters of one half of a permuted string: 26**12 fits a 64-bit integer with room to add.
HALF = 12

# Length of an IBAN by country.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
    25: "AO CV GW LY MZ PT ST", 26: "DZ IR IS TR", 27: "BI CF CG CM DJ FR GA GQ GR IT KM MC MG MR SM TD",
    28: "AL AZ BF BJ BY CI CY DO GT HN HU LB MA ML NE NI PL SN SV TG", 29: "BR EG PS QA UA", 30: "JO KW MU YE",
    31: "MT SC", 32: "LC", 33: "RU",
}


def _iban_pattern() -> str:
    """Of a listed country exactly as long as its numbers are, so that no word behind can join; of any other country as
    long as fits, up to a listed number."""
    forms = []
    for size, countries in IBAN_LENGTHS.items():
        fours, rest = divmod(size - 4, 4)
        tail = f" ?[A-Z0-9]{{{rest}}}" if rest else ""
        forms.append(f"(?:{countries.replace(' ', '|')})[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{{fours}}}{tail}")
    begin, end = "(?<![A-Za-z0-9])", "(?![A-Za-z0-9])"
    listed = f"{begin}(?:{'|'.join(forms)}){end}"
    known = "|".join(IBAN_LENGTHS.values()).replace(" ", "|")
    other = f"{begin}(?!{known})[A-Z]{{2}}[0-9]{{2}}(?: ?(?!{listed})[A-Z0-9]{{4}}){{2,7}}(?: ?[A-Z0-9]{{1,3}})?{end}"
    return f"(?:{listed}|{other})"


# Candidate patterns, tried in this order at each place of the text. Every repetition of a group is bounded, as
# Java's engine recurses in them; a host name has at most 127 labels of 63 characters.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@(?:[A-Za-z0-9-]{1,63}+\.){1,126}[A-Za-z]{2,63}",
    "iban": _iban_pattern(),
    "date_iso": r"(?<![A-Za-z0-9.-])[0-9]{4}-[0-9]{2}-[0-9]{2}(?!(?!T[0-9]{2}:)[A-Za-z0-9]|-[0-9])",  # or a time behind
    "date_year": r"(?<![A-Za-z0-9/])[0-9]{4}/[0-9]{2}/[0-9]{2}(?![A-Za-z0-9]|/[0-9])",
    "date_slash": r"(?<![A-Za-z0-9/])[0-9]{2}/[0-9]{2}/[0-9]{4}(?![A-Za-z0-9]|/[0-9])",
    # The same shape: month first where day first is no day.
    "date_month": r"(?<![A-Za-z0-9/])[0-9]{2}/[0-9]{2}/[0-9]{4}(?![A-Za-z0-9]|/[0-9])",
    "date_dot": r"(?<![A-Za-z0-9.])[0-9]{2}\.[0-9]{2}\.[0-9]{4}(?![A-Za-z0-9]|\.[0-9])",
    "ipv4": r"(?<![A-Za-z0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![A-Za-z0-9]|\.[0-9])",
    "card": r"(?<![A-Za-z0-9])(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){2}[ -][0-9]{1,7}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?![A-Za-z0-9])",
    "ssn": r"(?<![A-Za-z0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![A-Za-z0-9]|-[0-9])",
    "phone": r"(?<![A-Za-z0-9+])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![A-Za-z0-9])",
    "phone_plus": r"(?<![A-Za-z0-9+])\+[0-9]{1,3}(?:[ .-]?[0-9]{2,4}){2,4}(?![A-Za-z0-9])",
}
LOWER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "0123456789"
UPPER = LOWER.upper()
#: Days of one permuted range: 200 years of 365 days; a date stays in its range, counted from 0001-01-01.
SPAN_YEARS, SPAN_DAYS = 200, 365
#: Days after the 12th in a year, without a 29th of February.
LATE_DAYS = 221


def _digest(key: str, *parts: Column) -> Column:
    """60 keyed pseudo-random bits."""
    text = F.concat_ws("|", F.lit(key), *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("long")


def feistel(left: Column, right: Column, n_left: Column, n_right: Column, key: str, tweak: Column) -> Column:
    """A keyed permutation of pairs ``(left, right)`` below ``(n_left, n_right)``: a struct ``l, r``.

    Each round adds to one half a keyed function of the other, modulo its size, so every round can be undone.
    """

    def step(state: Column, i: Column) -> Column:
        even = i % 2 == 0
        l, r = state["l"], state["r"]
        new_l = F.when(even, (l + _digest(key, tweak, i, r) % n_left) % n_left).otherwise(l)
        new_r = F.when(even, r).otherwise((r + _digest(key, tweak, i, l) % n_right) % n_right)
        return F.struct(new_l.alias("l"), new_r.alias("r"))

    rounds = F.array(*[F.lit(i) for i in range(ROUNDS)])
    return F.aggregate(rounds, F.struct(left.cast("long").alias("l"), right.cast("long").alias("r")), step)


def _radix(c: Column) -> Column:
    return F.when(c.between("0", "9"), 10).when(c.between("a", "z") | c.between("A", "Z"), 26).otherwise(1).cast("long")


def _place(c: Column) -> Column:
    """Position of a character in its own alphabet."""
    return (
        F.when(c.between("0", "9"), F.ascii(c) - 48)
        .when(c.between("a", "z"), F.ascii(c) - 97)
        .when(c.between("A", "Z"), F.ascii(c) - 65)
        .otherwise(0)
        .cast("long")
    )


def _letter(c: Column, value: Column) -> Column:
    return (
        F.when(c.between("0", "9"), F.chr(value + 48))
        .when(c.between("a", "z"), F.chr(value + 97))
        .when(c.between("A", "Z"), F.chr(value + 65))
        .otherwise(c)
    )


def _number(chars: Column) -> Column:
    return F.aggregate(chars, F.lit(0).cast("long"), lambda acc, c: acc * _radix(c) + _place(c))


def _size(chars: Column) -> Column:
    return F.aggregate(chars, F.lit(1).cast("long"), lambda acc, c: acc * _radix(c))


def _spell(value: Column, chars: Column) -> Column:
    """The number in the alphabets of ``chars``."""
    start = F.struct(value.alias("rest"), F.lit("").alias("out"))

    def step(state: Column, c: Column) -> Column:
        radix = _radix(c)
        return F.struct(
            F.call_function("div", state["rest"], radix).alias("rest"),
            F.concat(_letter(c, state["rest"] % radix), state["out"]).alias("out"),
        )

    return F.aggregate(F.reverse(chars), start, step, lambda s: s["out"])


def permute_text(value: Column, key: str, kind: str) -> Column:
    """Each letter and digit moves within its alphabet, other characters stay; strings of one shape are permuted.

    Longer strings are permuted in parts of ``2 * HALF`` characters, each tweaked by its place.
    """
    chars = F.filter(F.split(value, ""), lambda c: c != "")
    parts = F.transform(
        F.sequence(F.lit(0), F.floor((F.greatest(F.size(chars), F.lit(1)) - 1) / (2 * HALF)).cast("int")),
        lambda i: F.slice(chars, i * (2 * HALF) + 1, F.lit(2 * HALF)),
    )

    def one(part: Column, i: Column) -> Column:
        cut = F.floor(F.size(part) / 2).cast("int")
        left, right = F.slice(part, F.lit(1), cut), F.slice(part, cut + 1, F.lit(2 * HALF))
        shape = F.array_join(F.transform(part, lambda c: _letter(c, F.lit(0))), "")
        mixed = feistel(_number(left), _number(right), _size(left), _size(right), key, F.concat_ws(":", F.lit(kind), i.cast("string"), shape))
        # A one-element array binds the pair, so that it is computed once.
        return F.transform(F.array(mixed), lambda m: F.concat(_spell(m["l"], left), _spell(m["r"], right)))[0]

    return F.array_join(F.transform(parts, one), "")


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn_sum(digits: Column) -> Column:
    """Luhn sum of a string of digits that ends in the check digit."""

    def worth(c: Column, i: Column) -> Column:
        d = F.ascii(c) - 48
        twice = 2 * d
        return F.when(i % 2 == 0, d).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    chars = F.filter(F.split(F.reverse(digits), ""), lambda c: c != "")
    return F.aggregate(F.transform(chars, worth), F.lit(0), lambda a, x: a + x)


def _pour(value: Column, digits: Column) -> Column:
    """``value`` with its digits replaced in order by ``digits``."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(state: Column, c: Column) -> Column:
        is_digit = c.between("0", "9")
        new = F.when(is_digit, F.substring(digits, state["at"] + 1, F.lit(1))).otherwise(c)
        return F.struct((state["at"] + is_digit.cast("int")).alias("at"), F.concat(state["out"], new).alias("out"))

    return F.aggregate(F.filter(F.split(value, ""), lambda c: c != ""), start, step, lambda s: s["out"])


def _bind(value: Column, fn: Callable[[Column], Column]) -> Column:
    """``fn(value)`` with ``value`` computed once."""
    return F.transform(F.array(value), fn)[0]


def _total(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0).cast("long"), lambda a, x: a + x)


def _running(sizes: Column, step: int = 128) -> Column:
    """For each entry the sum of those before it; blocks of ``step`` entries keep the work near the number of entries."""

    def of(xs: Column) -> Column:
        last = F.floor((F.greatest(F.size(xs), F.lit(1)) - 1) / step).cast("int")
        blocks = F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(xs, i * step + 1, F.lit(step)))

        def in_blocks(bs: Column) -> Column:
            def summed(totals: Column) -> Column:
                starts = F.transform(totals, lambda _, i: _total(F.slice(totals, F.lit(1), i)))
                return F.flatten(F.zip_with(bs, starts, lambda b, s: F.transform(b, lambda _, j: s + _total(F.slice(b, F.lit(1), j)))))

            return _bind(F.transform(bs, _total), summed)

        return _bind(blocks, in_blocks)

    return _bind(sizes, of)


def permute_card(value: Column, key: str) -> Column:
    """All but the first digit and the check digit are permuted; the check digit follows."""
    digits = digits_of(value)

    def rebuilt(d: Column) -> Column:
        inner = permute_text(F.substring(d, F.lit(2), F.length(d) - 2), key, "card")

        def closed(body: Column) -> Column:
            check = (10 - _luhn_sum(F.concat(body, F.lit("0"))) % 10) % 10
            return _pour(value, F.concat(body, check.cast("string")))

        return _bind(F.concat(F.substring(d, F.lit(1), F.lit(1)), inner), closed)

    return _bind(digits, rebuilt)


def _mod97(text: Column) -> Column:
    """Remainder by 97 of a string of digits and capital letters (A is 10)."""

    def step(acc: Column, c: Column) -> Column:
        letter = c.between("A", "Z")
        return F.when(letter, acc * 100 + F.ascii(c) - 55).otherwise(acc * 10 + F.ascii(c) - 48) % 97

    return F.aggregate(F.filter(F.split(text, ""), lambda c: c != ""), F.lit(0), step)


def iban_is_valid(value: Column) -> Column:
    plain = F.replace(value, F.lit(" "), F.lit(""))
    return F.length(plain).between(15, 34) & (_mod97(F.concat(F.substring(plain, 5, 40), F.substring(plain, 1, 4))) == 1)


def permute_iban(value: Column, key: str) -> Column:
    """Country and check digits stay in place, the account is permuted, and the check digits follow."""
    plain = F.replace(value, F.lit(" "), F.lit(""))

    def rebuilt(body: Column) -> Column:
        country = F.substring(plain, 1, 2)
        check = 98 - _mod97(F.concat(body, country, F.lit("00")))
        whole = F.concat(country, F.lpad(check.cast("string"), 2, "0"), body)
        start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

        def step(state: Column, c: Column) -> Column:
            gap = c == " "
            new = F.when(gap, c).otherwise(F.substring(whole, state["at"] + 1, F.lit(1)))
            return F.struct((state["at"] + (~gap).cast("int")).alias("at"), F.concat(state["out"], new).alias("out"))

        return F.aggregate(F.filter(F.split(value, ""), lambda c: c != ""), start, step, lambda s: s["out"])

    return _bind(permute_text(F.substring(plain, 5, 40), key, "iban"), rebuilt)


def parse_date(value: Column, kind: str) -> Column:
    """The date, or null where there is no such day."""
    pieces = {"date_iso": (1, 6, 9), "date_year": (1, 6, 9), "date_slash": (7, 4, 1), "date_month": (7, 1, 4), "date_dot": (7, 4, 1)}[kind]
    year, month, day = (F.substring(value, at, 4 if k == 0 else 2) for k, at in enumerate(pieces))
    return F.try_to_date(F.concat_ws("-", year, month, day), "yyyy-MM-dd")


def permute_date(value: Column, key: str, kind: str) -> Column:
    """Another day of the same 73,000-day range, written in the same form."""
    form = {"date_iso": "yyyy-MM-dd", "date_year": "yyyy/MM/dd", "date_slash": "dd/MM/yyyy", "date_dot": "dd.MM.yyyy"}[kind]
    size = SPAN_YEARS * SPAN_DAYS
    origin = F.to_date(F.lit("0001-01-01"))
    number = F.datediff(parse_date(value, kind), origin)

    def moved(n: Column) -> Column:
        inside = n % size
        half = F.floor(inside / SPAN_DAYS).cast("long")
        mixed = feistel(half, inside % SPAN_DAYS, F.lit(SPAN_YEARS), F.lit(SPAN_DAYS), key, F.concat(F.lit("date:"), ((n - inside) / size).cast("int").cast("string")))
        # The last range is cut at the year 9999: a value beyond it takes part in no exchange and stays.
        return F.transform(
            F.array(mixed),
            lambda m: F.date_format(F.date_add(origin, (n - inside + m["l"] * SPAN_DAYS + m["r"]).cast("int")), form),
        )[0]

    return _bind(number, moved)


def _late_days(year: Column) -> Column:
    """Days after the 12th of a month in the years 1 to ``year``."""
    return (year * LATE_DAYS + F.floor(year / 4) - F.floor(year / 100) + F.floor(year / 400)).cast("long")


def _late_date(number: Column) -> Column:
    """The date that ``number`` days after the 12th of a month precede, counted from 0001-01-13."""
    guess = F.floor(number / (LATE_DAYS + 0.2425)).cast("long")  # years before, at most one off

    def dated(past: Column) -> Column:
        start = F.make_date((past + 1).cast("int"), F.lit(1), F.lit(1))
        in_year = number - _late_days(past) + 1
        lasts = [F.dayofyear(F.last_day(F.add_months(start, m - 1))) - 12 * m for m in range(1, 12)]
        month = reduce(lambda n, last: n + (in_year > last).cast("int"), lasts, F.lit(1))
        return F.date_add(start, (in_year + 12 * month - 1).cast("int"))

    past = F.when(_late_days(guess) > number, guess - 1).when(_late_days(guess + 1) <= number, guess + 1).otherwise(guess)
    return _bind(past, dated)


def permute_month_first(value: Column, key: str) -> Column:
    """Another day after the 12th of a month of the same range of 44,200 such days: read with the day first it is no day
    again, so it equals no pseudonym of a date with the day first."""
    size = SPAN_YEARS * LATE_DAYS
    date = parse_date(value, "date_month")
    number = _late_days(F.year(date).cast("long") - 1) + F.dayofyear(date) - 12 * F.month(date) - 1

    def moved(n: Column) -> Column:
        inside = n % size
        half = F.floor(inside / LATE_DAYS).cast("long")
        part = F.concat(F.lit("month:"), ((n - inside) / size).cast("int").cast("string"))
        mixed = feistel(half, inside % LATE_DAYS, F.lit(SPAN_YEARS), F.lit(LATE_DAYS), key, part)
        # A lambda over one element binds the number, so that it is computed once.
        late = F.transform(F.array(mixed), lambda m: n - inside + m["l"] * LATE_DAYS + m["r"])[0]
        return _bind(late, lambda k: F.date_format(_late_date(k), "MM/dd/yyyy"))

    return _bind(number, moved)


def permute_ipv4(value: Column, key: str) -> Column:
    octets = F.split(value, "\\.")
    pair = [F.get(octets, F.lit(k)).cast("long") * 256 + F.get(octets, F.lit(k + 1)).cast("long") for k in (0, 2)]
    mixed = feistel(pair[0], pair[1], F.lit(65536), F.lit(65536), key, F.lit("ipv4"))
    return F.transform(
        F.array(mixed),
        lambda m: F.concat_ws(
            ".",
            F.shiftright(m["l"], 8).cast("string"),
            (m["l"] % 256).cast("string"),
            F.shiftright(m["r"], 8).cast("string"),
            (m["r"] % 256).cast("string"),
        ),
    )[0]


def permute_email(value: Column, key: str) -> Column:
    local = F.substring_index(value, "@", 1)
    return F.concat(permute_text(local, key, "email"), F.substring(value, F.length(local) + 1, F.length(value)))


def permute_phone(value: Column, key: str) -> Column:
    """The country code after a plus sign stays; the other digits are permuted."""
    code = F.regexp_extract(value, "^(\\+[0-9]{1,3}(?![0-9]))?", 1)
    rest = F.substring(value, F.length(code) + 1, F.length(value))
    return F.concat(code, permute_text(rest, key, "phone"))


def _valid(kind: str, value: Column) -> Column:
    if kind.startswith("date"):
        date = parse_date(value, kind)
        limit = F.to_date(F.lit("9800-01-01"))  # dates after the last whole range are not permuted
        return date.isNotNull() & (date < limit)
    if kind == "ipv4":
        return F.forall(F.split(value, "\\."), lambda x: x.cast("int") <= 255)
    if kind == "card":
        return (_luhn_sum(digits_of(value)) % 10 == 0) & (digits_of(value).cast("decimal(38,0)") > 0)
    if kind == "iban":
        return iban_is_valid(value)
    if kind == "ssn":
        area, group, serial = F.substring(value, 1, 3), F.substring(value, 5, 2), F.substring(value, 8, 4)
        return ~area.isin("000", "666") & (area < "900") & (group != "00") & (serial != "0000")
    if kind.startswith("phone"):
        return F.length(digits_of(value)).between(8, 15)
    return F.length(F.substring_index(value, "@", 1)) <= 64


def _permuted(kind: str, value: Column, key: str) -> Column:
    if kind == "date_month":
        return permute_month_first(value, key)
    if kind.startswith("date"):
        return permute_date(value, key, kind)
    if kind == "ssn":
        return permute_ssn(value, key)
    make = {"email": permute_email, "iban": permute_iban, "ipv4": permute_ipv4, "card": permute_card}
    return make.get(kind, permute_phone)(value, key)


def permute_ssn(value: Column, key: str) -> Column:
    """A valid number again: 898 areas (001 to 899 without 666), 99 groups and 9,999 serials are numbered and permuted."""
    area = F.substring(value, 1, 3).cast("long")
    area = area - F.when(area > 666, 2).otherwise(1)
    rest = (F.substring(value, 5, 2).cast("long") - 1) * 9999 + F.substring(value, 8, 4).cast("long") - 1
    mixed = feistel(area, rest, F.lit(898), F.lit(99 * 9999), key, F.lit("ssn"))

    def spelled(m: Column) -> Column:
        code = m["l"] + F.when(m["l"] >= 665, 2).otherwise(1)
        serial = m["r"] % 9999
        group = ((m["r"] - serial) / 9999).cast("long")
        return F.concat_ws(
            "-",
            F.lpad(code.cast("string"), 3, "0"),
            F.lpad((group + 1).cast("string"), 2, "0"),
            F.lpad((serial + 1).cast("string"), 4, "0"),
        )

    return F.transform(F.array(mixed), spelled)[0]


def _kind(value: Column) -> Column:
    """The first pattern that the whole candidate has and whose check passes; else null."""
    shapes = [(kind, value.rlike(f"^(?:{pattern})$")) for kind, pattern in PATTERNS.items()]
    return F.coalesce(*[F.when(shape, F.when(_valid(kind, value), F.lit(kind))) for kind, shape in shapes])


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """``row`` (a struct of the columns of ``docs``, with pseudonyms in ``text_col``) and ``pii``, an array of structs
    ``kind, start, value`` (the pseudonym and its place, in characters of the new text), for every row of ``docs``.

    A candidate that fails its check stays as it is. Null text stays null, with an empty array. Equal values
    under one key get equal pseudonyms in all rows. ``docs`` may have any other columns.
    """
    pattern = "|".join(dict.fromkeys(PATTERNS.values()))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    text = F.col("row")[text_col]
    may = text.rlike("[0-9@]")
    found = F.when(may, F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1)))
    rows = rows.withColumn("__found", F.coalesce(found, F.array().cast("array<string>")))
    kinds = F.transform("__found", lambda v: F.struct(v.alias("old"), _kind(v).alias("kind")))
    rows = rows.withColumn("__kinds", F.when(F.size("__found") > 0, kinds))

    def renamed(x: Column) -> Column:
        new = reduce(
            lambda rest, kind: F.when(x["kind"] == kind, _permuted(kind, x["old"], key)).otherwise(rest), PATTERNS, x["old"]
        )
        return F.struct(x["kind"].alias("kind"), new.alias("value"))

    rows = rows.withColumn("__new", F.when(F.exists("__kinds", lambda x: x["kind"].isNotNull()), F.transform("__kinds", renamed)))
    hit = F.col("__new").isNotNull()
    gaps = F.split(text, pattern, -1)
    values = F.concat(F.transform("__new", lambda x: x["value"]), F.array(F.lit("")))
    rows = rows.withColumn("__gaps", F.when(hit, gaps))
    joined = F.array_join(F.zip_with("__gaps", values, lambda g, v: F.concat(g, v)), "")
    before = F.transform(F.slice("__gaps", F.lit(1), F.size("__new")), lambda g: F.length(g).cast("long"))
    own = F.transform("__new", lambda x: F.length(x["value"]).cast("long"))
    begins = _running(F.zip_with(before, own, lambda g, v: g + v))
    places = F.zip_with(begins, before, lambda s, g: s + g)
    spans = F.zip_with(F.col("__new"), places, lambda x, at: F.struct(x["kind"].alias("kind"), at.alias("start"), x["value"].alias("value")))
    spans = F.filter(spans, lambda x: x["kind"].isNotNull())
    nothing = F.array().cast("array<struct<kind:string,start:bigint,value:string>>")
    new = F.col("row").withField(text_col, F.when(hit, joined).otherwise(text))
    return rows.select(new.alias("row"), F.when(hit, spans).otherwise(nothing).alias("pii"))
