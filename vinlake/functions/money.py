"""Currencies: conversion through a table of units per US dollar."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vinlake.functions.numbers import cents, half_up

#: Units per US dollar where no table is given: enough for tests, not for money.
SAMPLE_RATES = {"USD": 1.0, "EUR": 0.92, "KRW": 1400.0, "PLN": 4.0, "GBP": 0.79, "JPY": 150.0}
# Prices in ten thousands that mean "ask".
ASK_TENTHOUSANDS = (1, 10, 11, 77, 99, 111, 123, 777, 888, 999, 1111, 1234, 2222, 3333)


def rate_column(currency: Column, rates: dict[str, float] = SAMPLE_RATES) -> Column:
    """Units per dollar from a literal map: a join would be one row a currency."""
    table = F.create_map(*(F.lit(x) for pair in sorted(rates.items()) for x in pair))
    return F.element_at(table, F.upper(F.coalesce(currency, F.lit("USD"))))


def with_usd_eur(df: DataFrame, amount: str, currency: str, usd: str = "usd", eur: str = "eur", rates: dict[str, float] = SAMPLE_RATES) -> DataFrame:
    """df with two columns: the amount in dollars and euros to the cent; null for unknown currencies and without a euro rate."""
    per_eur = rates.get("EUR", 0.0)
    a, code = F.col(amount).cast("double"), F.upper(F.coalesce(F.col(currency), F.lit("USD")))
    per = rate_column(F.col(currency), rates)
    if not per_eur > 0:
        return df.withColumns({usd: F.lit(None).cast("double"), eur: F.lit(None).cast("double")})
    dollars = F.when(code == "USD", a).when(code == "EUR", a / per_eur).when(per > 0, a / per)
    euros = F.when(code == "EUR", a).otherwise(dollars * per_eur)
    return df.withColumns({usd: cents(dollars), eur: cents(euros)})


def resolved_usd_eur(amount: Column, currency: Column, kept_usd: Column, kept_eur: Column, rates: dict[str, float] = SAMPLE_RATES) -> tuple[Column, Column]:
    """Dollars and euros: those kept with the row first, then euros from kept dollars, then the table."""
    per_eur = F.lit(rates["EUR"])
    code = F.upper(F.coalesce(currency, F.lit("USD")))
    dollars = F.when(code == "USD", amount).when(code == "EUR", amount / per_eur).otherwise(amount / rate_column(currency, rates)).cast("double")
    euros = F.when(code == "EUR", amount.cast("double")).otherwise(dollars * per_eur)
    return F.coalesce(kept_usd.cast("double"), cents(dollars)), F.coalesce(F.when(kept_usd.isNotNull(), F.coalesce(kept_eur.cast("double"), cents(kept_usd * per_eur))), cents(euros))


def effective_usd(usd: Column, amount: Column, currency: Column) -> Column:
    """The dollar price of a filter: the kept one, else the amount if it is in dollars."""
    return F.coalesce(usd.cast("double"), F.when(F.upper(currency) == "USD", amount.cast("double")))


def from_tenthousands(raw: Column) -> tuple[Column, Column]:
    """(amount, ask) of a price that is stated in ten thousands, or in full from 100,000 on. ask: the price is a stand-in for "on request"."""
    tens = F.when(raw >= 100_000, raw / 10_000).otherwise(raw.cast("double"))
    whole = half_up(tens)
    ask = (whole < 20) | whole.isin(*ASK_TENTHOUSANDS) | whole.cast("string").rlike(r"^(\d)\1{2,}$")
    return F.when(raw > 0, half_up(tens * 10_000)), F.when(raw > 0, ask).otherwise(True)


def whole_usd_eur(df: DataFrame, amount: str, currency: str, usd: str, eur: str, rates: dict[str, float] = SAMPLE_RATES) -> DataFrame:
    """Fills null whole-number dollar and euro columns; filled ones stay."""
    found = with_usd_eur(df, amount, currency, "_usd", "_eur", rates)
    return found.withColumns({usd: F.coalesce(F.col(usd), half_up(F.col("_usd"))), eur: F.coalesce(F.col(eur), half_up(F.col("_eur")))}).drop("_usd", "_eur")
