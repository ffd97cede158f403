"""Display texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wattledger.functions.numbers import round_half_up


def ordinal_label(rank: Column) -> Column:
    """1st, 2nd, 3rd, then always 'th' (21 gives 21th)."""
    return (
        F.when(rank == 1, F.lit("1st"))
        .when(rank == 2, F.lit("2nd"))
        .when(rank == 3, F.lit("3rd"))
        .otherwise(F.concat(rank.cast("string"), F.lit("th")))
    )


def currency_symbol(currency: Column) -> Column:
    """Peso sign for PHP, dollar sign for all else; amounts are not converted."""
    return F.when(currency == "PHP", F.lit("₱")).otherwise(F.lit("$"))


def whole_money(amount: Column, currency: Column | None = None, grouping: bool = False) -> Column:
    """Symbol and rounded amount; ``grouping`` adds thousands separators."""
    symbol = F.lit("₱") if currency is None else currency_symbol(currency)
    whole = round_half_up(amount).cast("bigint")
    return F.concat(symbol, F.format_number(whole, 0) if grouping else whole.cast("string"))


def is_mail_domain(address: Column, domain: str, ignore_case: bool) -> Column:
    return F.endswith(F.lower(address) if ignore_case else address, F.lit(domain))
