"""Checksums, arithmetic checks and confidence as Column expressions."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F


def _weighted(text: Column, weights: tuple[int, ...], begin: int = 1, each_mod: int | None = None) -> Column:
    """Sum of digits times weights, from the given place on (each product modulo each_mod, if given)."""
    parts = [F.substring(text, begin + i, 1).try_cast("int") * w for i, w in enumerate(weights)]
    return sum((p % each_mod if each_mod else p for p in parts), F.lit(0))


#: Weights of the check digits of a taxpayer's number.
INN_10, INN_11, INN_12 = (2, 4, 10, 3, 5, 9, 4, 6, 8), (7, 2, 4, 10, 3, 5, 9, 4, 6, 8), (3, 7, 2, 4, 10, 3, 5, 9, 4, 6, 8)


def inn_valid(text: Column) -> Column:
    """A number of 10 or 12 digits whose check digits are right; null for null."""
    digit = lambda i: F.substring(text, i, 1).try_cast("int")
    check = lambda w: _weighted(text, w) % 11 % 10
    return (
        F.when(text.rlike(r"^\d{10}$"), check(INN_10) == digit(10))
        .when(text.rlike(r"^\d{12}$"), (check(INN_11) == digit(11)) & (check(INN_12) == digit(12)))
        .when(text.isNotNull(), False)
    )


#: Fixed value: a bank's code is 04, a region of three digits above 0, and a branch of four digits, 0 or from 50 on.
BIK = r"^04(?!000)\d{3}(0000|00[5-9]\d|0[1-9]\d\d|[1-9]\d{3})$"


def digits(text: Column) -> Column:
    return F.regexp_replace(text, r"\D", "")


def bik_valid(text: Column) -> Column:
    """Whether the digits are a bank's code; null for null."""
    return digits(text).rlike(BIK)


def kpp_valid(text: Column) -> Column:
    return F.trim(text).rlike(r"^\d{4}[\p{L}\d]{2}\d{3}$")


def account_valid(account: Column, bik: Column) -> Column:
    """The control key of 20 digits: behind the last three digits of the bank's code (accounts of clients), or behind 0 and its
    fifth and sixth digit (accounts of banks), weights 7, 1, 3 in turn add up to a multiple of ten. Null for null."""
    own, bank = digits(account), digits(bik)
    fits = lambda prefix: _weighted(F.concat(prefix, own), ((7, 1, 3) * 8)[:23]) % 10 == 0
    either = fits(F.substring(bank, 7, 3)) | fits(F.concat(F.lit("0"), F.substring(bank, 5, 2)))
    return F.when(own.rlike(r"^\d{20}$") & bank.rlike(r"^\d{9}$"), either).when(account.isNotNull() & bik.isNotNull(), False)


#: Rates of value added tax.
RATES = (0.2, 0.1)


def sum_of_cents(amount: Column) -> Column:
    """Sum of amounts (double), each in whole cents. The double itself is rounded: a cast to decimal rounds the shortest number that
    stands for it, so that half a cent goes up where the double is a little less."""
    return F.sum(F.round(amount * 100).cast("decimal(20,0)")).cast("double") / 100


def total_fits(lines: Column, tax: Column, total: Column, share: float = 0.01) -> Column:
    """Whether the sum of the lines, the tax and the total go together within max(1, 1 %): the tax on top; or lines that hold it,
    at one of the rates; or the tax and the total that follow from a rate. False if one of them is missing."""
    room = F.greatest(F.lit(1.0), F.abs(F.when(total != 0, total).otherwise(lines)) * share)
    near = lambda a, b: F.abs(a - b) <= room
    held = [near(lines, total) & near(tax, total * r / (1 + r)) for r in RATES]
    derived = [near(tax, lines * r) & near(total, lines * (1 + r)) for r in RATES]
    return F.coalesce(reduce(or_, [near(lines + tax, total), *held, *derived]), F.lit(False))


def confidence(value: Column, verified: Column, ambiguous: Column, prior: float = 0.95) -> Column:
    """0 for nothing, 0.98 verified, 0.25 failed, 0.6 ambiguous, else the prior."""
    return F.when(value.isNull(), 0.0).when(verified, 0.98).when(~verified, 0.25).when(ambiguous, 0.6).otherwise(prior)


def money(value: Column, digits: int = 2) -> Column:
    """Thousands by blanks, a comma before the fraction."""
    return F.translate(F.format_number(value, digits), ",.", " ,")


#: Letters taken for digits, and the digits.
LOOK_ALIKES = ("OoОоlIЗзБ", "000011336")


def repaired_digits(text: Column, valid) -> Column:
    """Look-alikes as digits, if only then the check passes."""
    fixed = F.translate(text, *LOOK_ALIKES)
    return F.when(F.coalesce(valid(text), F.lit(False)), text).when(F.coalesce(valid(fixed), F.lit(False)), fixed).otherwise(text)
