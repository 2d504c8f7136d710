"""Format-preserving pseudonyms for personal data, in DataFrame functions alone.

Matches of one pattern are validated by kind: card numbers by their check digit, IBANs by their remainder, dates
by the calendar, addresses by their octets, phone numbers (after a country code or a trunk 0, or as 3 and 4 digits
after an area code) by their length. Valid ones go through an eight-round
Feistel network under a secret key, within their format: digits stay digits in place, check digits are made anew,
a date becomes a date, an address an address. Equal values get equal pseudonyms in every document, and different
values of one format different ones. E-mail addresses and secrets get a keyed hash in their format.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .store import unused

_IN, _OUT = r"(?<![\p{L}\p{N}])", r"(?![\p{L}\p{N}])"
#: The kinds in the order in which they are tried at a place.
PATTERNS = {
    # with the lengths that addresses may have, and from a boundary on, so that long runs of letters cost no more than others
    "email": _IN + r"[\p{L}\p{N}][\p{L}\p{N}._%+-]{0,63}@[\p{L}\p{N}-]{1,63}(?:\.[\p{L}\p{N}-]{1,63}){0,8}\.\p{L}{2,63}" + _OUT,
    # in one piece before secrets, which may have the same letters and digits; with blanks after them
    "account": _IN + r"[A-Z]{2}[0-9]{2}[0-9A-Z]{11,30}" + _OUT,
    "secret": _IN + r"(?:AKIA[0-9A-Z]{16}|(?=[0-9]*[a-fA-F])[0-9a-fA-F]{16,64})" + _OUT,
    "iban": _IN + r"[A-Z]{2}[0-9]{2}(?: ?[0-9A-Z]{4}){2,7}(?: ?[0-9A-Z]{1,3})?" + _OUT,
    "address": _IN + r"(?<![0-9]\.)[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?!\.[0-9])" + _OUT,
    # also the date of a timestamp
    "date": _IN + r"(?:[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}(?:(?=T[0-9]{2}:)|" + _OUT + r")|(?:[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}|[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4})" + _OUT + ")",
    "card": _IN + r"(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})" + _OUT,
    "ssn": _IN + r"[0-9]{3}-[0-9]{2}-[0-9]{4}" + _OUT,
}
#: A digit of a phone number with a mark before it, unless another kind begins there; numbers have 15 digits at most.
_MORE = r"(?:[ \u00A0\u202F./-](?!" + "|".join(PATTERNS[k] for k in ("address", "date", "card", "ssn")) + r"))?[0-9]"
#: A number that such a word names is no phone number.
_NAMES = "ISBN ISSN order invoice ref reference number no nr id Bestellung Bestellnummer Rechnung Nummer commande facture numéro pedido factura número".split()
_UNNAMED = r"(?<!(?<![\p{L}])(?i:" + "|".join(_NAMES) + r")(?:-1[03])?[ .:#]{0,3})(?<!#)"
_PLUS = r"(?<![\p{L}\p{N}+])\+"
_PHONES = [
    _PLUS + r"1[ .-]?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-]?[0-9]{4}",
    _PLUS + rf"[1-9](?:{_MORE}){{6,14}}",
    _PLUS + rf"[1-9][0-9]{{0,2}}[ .-]?(?:\(0\) ?[0-9](?:{_MORE}){{5,10}}|\([0-9]{{2,3}}\)(?:{_MORE}){{4,9}}|\([0-9]{{4,5}}\)(?:{_MORE}){{3,7}})",
    _IN + _UNNAMED + rf"(?<![0-9][./-])0[0-9](?:{_MORE}){{5,13}}",
    _IN + rf"\(0[0-9]{{1,5}}\)(?:{_MORE}){{3,9}}",
    r"(?:(?<![\p{L}\p{N}+])\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\) ?|" + _IN + r"(?<![0-9][.-])[0-9]{2,4}[ .-])[0-9]{3}[ .-]?[0-9]{4}",
]
PATTERNS["phone"] = "(?:" + "|".join(_PHONES) + ")" + _OUT
EVERY = "|".join(f"(?:{p})" for p in PATTERNS.values())
ROUNDS = 8
#: A date is permuted among the SPAN * SPAN days of its block, about two centuries; blocks begin at 1900-01-01.
SPAN = 270
WALK = 256


def _let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _noise(key: str, *parts) -> Column:
    """A number of 60 bits from the key and the parts."""
    text = F.concat_ws("|", F.lit(key), *(p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts))
    return F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("long")


def _feistel(key: str, tweak, a: Column, b: Column, size_a: Column, size_b: Column) -> Column:
    """struct(a, b) permuted among 0 <= a < size_a, 0 <= b < size_b."""

    def step(acc, i):
        even = i % 2 == 0
        return F.struct(
            F.when(even, F.pmod(acc["a"] + _noise(key, tweak, i, acc["b"]) % size_a, size_a)).otherwise(acc["a"]).alias("a"),
            F.when(even, acc["b"]).otherwise(F.pmod(acc["b"] + _noise(key, tweak, i, acc["a"]) % size_b, size_b)).alias("b"),
        )

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), F.struct(a.cast("long").alias("a"), b.cast("long").alias("b")), step)


def permute_digits(key: str, kind: str, digits: Column) -> Column:
    """A string of 2 to 36 digits, permuted among those of its length."""

    def run(d):
        n = F.length(d)
        left = F.floor(n / 2).cast("int")
        ten = lambda k: F.rpad(F.lit("1"), k + 1, "0").cast("long")
        halves = _feistel(key, F.concat(F.lit(kind), n), F.substring(d, F.lit(1), left).cast("long"), F.substring(d, left + 1, n).cast("long"), ten(left), ten(n - left))
        return _let(halves, lambda h: F.concat(F.lpad(h["a"].cast("string"), left, "0"), F.lpad(h["b"].cast("string"), n - left, "0")))

    return _let(digits, run)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _refill(value: Column, digits: Column) -> Column:
    """value with its digits replaced in place by others."""
    of = lambda i: F.length(_digits(F.substring(value, F.lit(1), i)))
    return _let(digits, lambda d: F.array_join(F.transform(F.sequence(F.lit(1), F.length(value)),
        lambda i: F.when(F.substring(value, i, F.lit(1)).rlike("[0-9]"), F.substring(d, of(i), F.lit(1))).otherwise(F.substring(value, i, F.lit(1)))), ""))


def luhn_sum(digits: Column) -> Column:
    """The weighted sum of a card number's digits; a valid one's ends in 0."""

    def weigh(i):
        d = F.substring(F.reverse(digits), i, F.lit(1)).cast("int")
        return F.when(i % 2 == 1, d).otherwise(F.when(d * 2 > 9, d * 2 - 9).otherwise(d * 2))

    return F.aggregate(F.transform(F.sequence(F.lit(1), F.length(digits)), weigh), F.lit(0), lambda a, x: a + x)


def _card(key: str, m: Column) -> Column:
    def run(d):
        body = permute_digits(key, "card", F.substring(d, F.lit(1), F.length(d) - 1))
        return _let(body, lambda b: F.concat(b, F.pmod(10 - luhn_sum(F.concat(b, F.lit("0"))) % 10, F.lit(10)).cast("string")))

    return _let(_digits(m), lambda d: F.when(luhn_sum(d) % 10 == 0, _refill(m, run(d))).otherwise(m))


def iban_rest(value: Column) -> Column:
    """Remainder by 97 of an IBAN without blanks; 1 for a valid one."""
    moved = F.concat(F.substring(value, F.lit(5), F.length(value)), F.substring(value, 1, 4))

    def add(acc, i):
        c = F.substring(moved, i, F.lit(1))
        return F.when(c.rlike("[0-9]"), (acc * 10 + c.cast("int")) % 97).otherwise((acc * 100 + F.ascii(c) - 55) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(value)), F.lit(0), add)


def _iban(key: str, m: Column) -> Column:
    def run(v):
        tail = F.substring(v, F.lit(5), F.length(v))
        body = _let(tail, lambda t: F.when(F.length(_digits(t)) >= 2, _refill(t, permute_digits(key, "iban", _digits(t)))).otherwise(t))

        def checked(b):
            rest = iban_rest(F.concat(F.substring(v, 1, 2), F.lit("00"), b))
            return F.concat(F.substring(v, 1, 2), F.lpad((98 - rest).cast("string"), 2, "0"), b)

        return _let(body, checked)

    spaced = lambda v: F.array_join(F.transform(F.sequence(F.lit(1), F.length(m)),
        lambda i: F.when(F.substring(m, i, F.lit(1)) == " ", " ").otherwise(F.substring(v,
            i - F.length(F.regexp_replace(F.substring(m, F.lit(1), i), "[^ ]", "")), F.lit(1)))), "")
    return _let(F.regexp_replace(m, " ", ""), lambda v: F.when(iban_rest(v) == 1, _let(run(v), spaced)).otherwise(m))


def _address(key: str, m: Column) -> Column:
    def run(p):
        o = lambda i: p[i].cast("long")
        halves = _feistel(key, "address", o(0) * 256 + o(1), o(2) * 256 + o(3), F.lit(65536), F.lit(65536))
        parts = lambda h: F.concat_ws(".", *((x / y).cast("long").cast("string") if y > 1 else x.cast("string") for x,
            y in ((h["a"], 256), (h["a"] % 256, 1), (h["b"], 256), (h["b"] % 256, 1))))
        return F.when(F.forall(p, lambda x: x.cast("int") <= 255), _let(halves, parts)).otherwise(m)

    return _let(F.split(m, r"\."), run)


def _date(key: str, m: Column) -> Column:
    """A date in the digits of m. Slashes are read as day, month, year, or else as month, day, year.

    Dates in two-digit days and months are permuted among all; those of another form (one digit, or month first)
    among that form's: they are moved on until they are of that form again.
    """
    part, epoch = F.split(m, r"[-/.]"), F.lit("1900-01-01").cast("date")
    letters = lambda i, c: F.when(F.length(part[i]) == 1, c).otherwise(c * 2)
    parsed = lambda form: F.datediff(F.try_to_timestamp(m, form).cast("date"), epoch).cast("long")
    of_day = lambda n: F.date_add(epoch, n.cast("int"))

    def through(form: Column, month_first: Column) -> Column:
        usual = form.isin("yyyy-MM-dd", "dd/MM/yyyy", "dd.MM.yyyy")
        written = lambda n: F.call_function("date_format", of_day(n), form)
        fits = lambda n: usual | ((F.length(written(n)) == F.length(m)) & (F.regexp_replace(written(n), "[0-9]", "0") == F.regexp_replace(m, "[0-9]",
            "0")) & (~month_first | (F.dayofmonth(of_day(n)) > 12)))

        def moved(n):
            block = F.floor(n / (SPAN * SPAN))
            within = n - block * (SPAN * SPAN)
            tweak = F.concat(F.lit("date"), F.when(usual, "").otherwise(F.concat(F.lit("|"), form, F.lit("|"))), block)
            halves = _feistel(key, tweak, F.floor(within / SPAN), within % SPAN, F.lit(SPAN), F.lit(SPAN))
            return _let(halves, lambda h: block * (SPAN * SPAN) + h["a"] * SPAN + h["b"])

        def run(n):
            # the form with the fewest has a fifth of all dates: WALK steps fail with a chance below 1e-24
            steps = F.when(usual, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.lit(WALK - 1)))
            return written(F.aggregate(steps, n, lambda at, i: F.when((i > 0) & fits(at), at).otherwise(moved(at))))

        return _let(parsed(form), lambda n: F.when(n.isNull() | (n < -SPAN * SPAN * 9) | (n >= SPAN * SPAN * 40), m).otherwise(run(n)))

    iso = F.concat(F.lit("yyyy-"), letters(1, "M"), F.lit("-"), letters(2, "d"))
    slashes, dots = (F.concat(letters(0, "d"), F.lit(c), letters(1, "M"), F.lit(c + "yyyy")) for c in "/.")
    month_first = m.contains("/") & F.try_to_timestamp(m, slashes).isNull()
    form = F.when(m.contains("-"), iso).when(month_first, F.concat(letters(0, "M"), F.lit("/"), letters(1, "d"),
        F.lit("/yyyy"))).when(m.contains("/"), slashes).otherwise(dots)
    return _let(F.struct(form.alias("form"), month_first.alias("month_first")), lambda f: through(f["form"], f["month_first"]))


def _plain(key: str, kind: str, m: Column, least: int, most: int) -> Column:
    """All digits after a country code permuted."""
    code = F.regexp_extract(m, r"^\+[0-9]{1,3}", 0)
    rest = F.substring(m, F.length(code) + 1, F.length(m))
    return F.when(F.length(_digits(m)).between(least, most), F.concat(code, _let(rest, lambda r: _refill(r, permute_digits(key, kind, _digits(r)))))).otherwise(m)


def _secret(key: str, m: Column) -> Column:
    def hashed(k, alphabet_from: str = "", alphabet_to: str = ""):
        h = F.sha2(F.concat(F.lit(f"{key}|secret{k}|"), m), 256)
        return F.translate(h, alphabet_from, alphabet_to) if alphabet_from else h

    cloud = F.concat(F.lit("AKIA"), F.substring(F.upper(hashed(1, "0189", "ghij")), 1, 16))
    plain = F.substring(hashed(2), F.lit(1), F.length(m))
    return F.when(m.startswith("AKIA"), cloud).when(m.rlike("[A-F]"), F.upper(plain)).otherwise(plain)


def _email(key: str, m: Column) -> Column:
    return F.concat(F.lit("u"), F.substring(F.sha2(F.concat(F.lit(f"{key}|email|"), F.lower(m)), 256), 1, 16), F.lit("@example.invalid"))


def pseudonym(key: str, m: Column) -> Column:
    """The pseudonym of one match of EVERY, or the match itself where it isn't valid."""
    whole = lambda kind: m.rlike(f"^(?:{PATTERNS[kind]})$")
    account = whole("iban") & (iban_rest(F.regexp_replace(m, " ", "")) == 1)
    out = F.when(m.contains("@"), _email(key, m)).when(account, _iban(key, m)).when(whole("secret"), _secret(key, m)).when(whole("iban"), m)
    out = out.when(whole("address"), _address(key, m)).when(whole("date"),
        _date(key, m)).when(whole("card") & (~m.startswith("0") | (luhn_sum(_digits(m)) % 10 == 0)), _card(key, m))
    return out.when(whole("ssn"), _plain(key, "ssn", m, 9, 9)).otherwise(_plain(key, "phone", m, 7, 15))


def pseudonymise(docs: DataFrame, key: str, column: str = "text", count: str | None = "n_replaced") -> DataFrame:
    """docs with the personal data in a text column replaced; every other column stays.

    count names a column for the number of replaced values (none if None). A null text stays null (count 0), an
    empty one empty. Text without a match is returned byte for byte; values that fail their check stay as they
    are. Texts of any length are read whole. Repeated rows, and ties of one value in several forms (an account with and
    without blanks), get equal pseudonyms. An empty table gives an empty result. A column named as the count is replaced.
    """
    text = F.col(f"`{column}`")
    found = F.when(text.rlike(r"[0-9@]"), F.regexp_extract_all(text, F.lit(EVERY), F.lit(0))).otherwise(F.array().cast("array<string>"))
    # a projection each: what is computed in one is an input of the next and isn't computed again
    old, new = unused(docs.columns, "found_values"), unused(docs.columns, "new_values")
    out = docs.withColumn(old, found).withColumn(new, F.transform(old, lambda m: pseudonym(key, m)))
    gaps = F.split(text, EVERY)
    woven = F.array_join(F.flatten(F.zip_with(gaps, F.concat(new, F.array(F.lit(""))), lambda g, m: F.array(g, m))), "")
    out = out.withColumn(column, F.when(F.size(old) > 0, woven).otherwise(text))
    if count:
        out = out.withColumn(count, F.coalesce(F.size(F.filter(F.zip_with(old, new, lambda a, b: a != b), lambda x: x)), F.lit(0)).cast("long"))
    return out.drop(old, new)
