"""Repair of extracted fields: recovery from text, derived subtotals, swapped numbers, rules, prices per unit; as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.functions.checks import BIK, digits

#: Months as they stand in written dates.
MONTHS = ("января", "февраля", "марта", "апреля", "мая", "июня", "июля", "августа", "сентября", "октября", "ноября", "декабря")


def found_number(text: Column) -> Column:
    """The number behind № or No., if there is one."""
    found = F.regexp_extract(text, r"(?i)(?:№\s*|\bNo(?:\.\s*|\s+))([\p{L}\d][\p{L}\d/-]*)", 1)
    return F.when(found != "", found)


def found_date(text: Column) -> Column:
    """The first date, as 31.12.2024 or as a day, a month's name and a year."""
    short = F.try_to_timestamp(F.regexp_extract(text, r"(\d{2}\.\d{2}\.\d{4})", 1), F.lit("dd.MM.yyyy")).cast("date")
    pattern = rf"(?iu)(\d{{1,2}})\s+({'|'.join(MONTHS)})\s+(\d{{4}})"
    month = F.array_position(F.lit(list(MONTHS)), F.lower(F.regexp_extract(text, pattern, 2)))
    long = F.try_to_timestamp(F.concat_ws(".", F.regexp_extract(text, pattern, 1), month.cast("string"), F.regexp_extract(text, pattern, 3)), F.lit("d.M.yyyy")).cast("date")
    return F.coalesce(short, long)


def subtotal(given: Column, tax: Column, total: Column) -> Column:
    """Total less tax, where the subtotal is missing or is the total although there is a tax."""
    derived = F.round(total - tax, 2)
    return F.when((tax > 0) & (given.isNull() | (F.abs(given - total) <= 0.01)), derived).otherwise(given)


def unswapped(account: Column, bik: Column) -> Column:
    """account and bik, changed round where each looks like the other."""
    a, b = digits(account), digits(bik)
    swapped = a.rlike(BIK) & (F.length(b) == 20)
    return F.struct(F.when(swapped, bik).otherwise(account).alias("account"), F.when(swapped, account).otherwise(bik).alias("bik"))


def by_rules(value: Column, rules: list[tuple[str, str, bool]]) -> Column:
    """Rules (from, to, whether from is a pattern) applied in order."""
    apply = lambda c, r: F.regexp_replace(c, r[0], r[1]) if r[2] else F.when(c == r[0], r[1]).otherwise(c)
    return reduce(apply, rules, value)


def net_price(price: Column, rate: Column, held: Column, pack: Column) -> Column:
    """Price of one piece without tax. A rate above 1 is a percentage, none is 20 %; held: whether the price holds the tax."""
    share = F.coalesce(F.when(rate > 1, rate / 100).otherwise(rate), F.lit(0.2))
    return F.when(held, price / (1 + share)).otherwise(price) / F.greatest(F.lit(1.0), F.coalesce(pack.cast("double"), F.lit(1.0)))


#: The tax rate where none is given, and days after which a price is old.
TAX_RATE, STALE_AFTER = 0.2, 180


def on_basis(price: Column, rate: Column, held: Column, pack: Column, target_held: Column) -> Column:
    """A catalog's price for one piece, with the tax if the target's prices hold it, else without: price (4 digits), tax_assumed (it was
    not said whether the price holds the tax: it is taken not to), pack_normalized. A rate above 1 is a percentage."""
    packed = F.coalesce(pack > 1, F.lit(False))
    one = F.when(packed, price / pack).otherwise(price)
    share = F.coalesce(F.when(rate > 1, rate / 100).otherwise(rate), F.lit(TAX_RATE))
    own = F.coalesce(held, F.lit(False))
    brought = F.when(target_held & ~own, one * (1 + share)).when(~target_held & own, one / (1 + share)).otherwise(one)
    return F.struct(brought.alias("exact"), F.round(brought, 4).alias("price"), held.isNull().alias("tax_assumed"), packed.alias("pack_normalized"))


def price_comparison(price: Column, known: Column, on: Column, valid_until: Column, recorded: Column, room_percent: float = 5.0) -> Column:
    """An invoice's price against a catalog's (exact, on the same basis): verdict (unknown where either is missing or 0), difference_pct
    (2 digits), stale_days (of prices past their date, or old ones without a date)."""
    missing = price.isNull() | (price == 0) | known.isNull() | (known == 0)
    gap = F.try_divide(price - known, known) * 100
    verdict = F.when(missing, "unknown").when(F.abs(gap) <= room_percent, "ok").when(gap > 0, "above_catalog").otherwise("below_catalog")
    age = F.datediff(on, F.coalesce(valid_until, recorded))
    stale = F.when(F.when(valid_until.isNotNull(), age > 0).otherwise(age > STALE_AFTER), age)
    return F.struct(verdict.alias("verdict"), F.when(~missing, F.round(gap, 2)).alias("difference_pct"), F.when(~missing, stale).alias("stale_days"))


def price_verdict(price: Column, known: Column, age_days: Column, room: float = 0.05, stale: int = 180) -> Column:
    """no_price, stale, ok within the room, else higher or lower."""
    gap = (price - known) / known
    return F.when(known.isNull() | (known == 0), "no_price").when(age_days > stale, "stale").when(F.abs(gap) <= room + 1e-9, "ok").when(gap > 0, "higher").otherwise("lower")


def requisite(value: Column, lengths: list[int], optional: bool = False) -> Column:
    """missing (or ok, if it may be), error where the digits' length is none of those, else ok."""
    size = F.length(digits(value))
    return F.when(value.isNull() | (value == ""), "ok" if optional else "missing").when(size.isin(lengths), "ok").otherwise("error")


def typed(text: Column, kind: str) -> Column:
    """A written cell as a number (blanks out, a comma as the point) or a date (three formats); null where it is neither."""
    if kind == "number":
        return F.replace(F.regexp_replace(text, r"[\s\x{a0}]", ""), F.lit(","), F.lit(".")).try_cast("double")
    return F.coalesce(*(F.try_to_timestamp(F.trim(text), F.lit(f)).cast("date") for f in ("yyyy-MM-dd", "dd.MM.yyyy", "dd.MM.yy")))


def containment(number: Column, line: Column, tokens: Column, own: Column) -> Column:
    """1 where the part number stands in the line, blanks and signs apart; else the share of the entry's words in it."""
    bare = lambda c: F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]", "")
    share = F.size(F.array_intersect(own, tokens)) / F.size(own)
    return F.when((bare(number) != "") & F.contains(bare(line), bare(number)), 1.0).otherwise(F.coalesce(F.when(F.size(own) > 0, share), F.lit(0.0)))


def first_marker(text: Column, markers: list[tuple[str, str]], default: str) -> Column:
    """What the first marker that the text holds stands for."""
    return F.coalesce(*(F.when(F.contains(F.lower(text), F.lit(m)), v) for m, v in markers), F.lit(default))


def file_kind(name: Column, mime: Column, by_ending: dict[str, str], by_mime: dict[str, str]) -> Column:
    """The kind by the file's ending, else by its type, else other."""
    of = lambda m, k: F.element_at(F.create_map(*(F.lit(x) for pair in m.items() for x in pair)), k)
    return F.coalesce(of(by_ending, F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))), of(by_mime, F.lower(mime)), F.lit("other"))
