"""The 14 features of a transaction, in their fixed order, as 16-bit integers.

`transactions` have the nested columns of `schemas.REQUEST`. Missing numbers and flags count as zero and false;
without a last transaction dimensions 5 and 6 are -1; an unknown category has a risk of one half; where
the customer has no average the ratio is 1. Hours and weekdays are those of UTC, weeks begin on Monday. A time
that is missing or can't be read makes what depends on it null, and such a vector can't be searched.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from nearvote.functions.quantize import q16, single
from nearvote.functions.vectors import clamped

DIMS = 14
FEATURES = (
    "amount", "installments", "amount_vs_average", "hour", "weekday", "minutes_since_last", "km_from_last",
    "km_from_home", "tx_count_24h", "is_online", "card_present", "unknown_merchant", "mcc_risk", "merchant_average",
)

#: The risk of merchant categories; others have UNKNOWN_RISK.
MCC_RISK = {
    "5411": 0.15, "5812": 0.30, "5912": 0.20, "5944": 0.45, "7801": 0.80,
    "7802": 0.75, "7995": 0.85, "4511": 0.35, "5311": 0.25, "5999": 0.50,
}
UNKNOWN_RISK = 0.5


@dataclass(frozen=True)
class Limits:
    """Where each feature reaches 1."""

    amount: float = 10_000
    installments: float = 12
    amount_vs_average: float = 10
    minutes: float = 1440
    km: float = 1000
    tx_count_24h: float = 20
    merchant_average: float = 10_000
    mcc_risk: dict[str, float] = field(default_factory=lambda: dict(MCC_RISK))


#: The names of the limits in a file of constants.
LIMIT_NAMES = {
    "amount": "max_amount", "installments": "max_installments", "amount_vs_average": "amount_vs_avg_ratio", "minutes": "max_minutes",
    "km": "max_km", "tx_count_24h": "max_tx_count_24h", "merchant_average": "max_merchant_avg_amount",
}


def inverse(x: float) -> Column:
    """The single-precision reciprocal; constants are folded when the plan is made."""
    return (single(1.0) / single(x)).cast("float")


def risk(mcc: Column, table: dict[str, float]) -> Column:
    """The quantized risk of a category."""
    pairs = [F.lit(x) for k, v in sorted(table.items()) for x in (k, int(round(v * 10_000)))]
    known = F.try_element_at(F.create_map(*pairs), mcc) if pairs else F.lit(None).cast("int")
    return F.coalesce(known, F.lit(int(UNKNOWN_RISK * 10_000))).cast("smallint")


def feature_columns(limits: Limits = Limits()) -> list[Column]:  # noqa: B008
    """One smallint expression for each feature, over the columns of a transaction."""
    zero = lambda c, kind="double": F.coalesce(F.col(c).cast(kind), F.lit(0).cast(kind))
    scaled = lambda c, top, kind="double": q16(clamped((zero(c, kind) * inverse(top)).cast("float")))
    when = F.try_to_timestamp("transaction.requested_at")
    last = F.col("last_transaction")
    micros = F.unix_micros(when) - F.unix_micros(F.try_to_timestamp("last_transaction.timestamp"))
    minutes = (F.when(micros.isNotNull(), F.greatest(micros, F.lit(0))) * 10).cast("double") * (F.lit(1.0) / F.lit(600_000_000.0))
    since = F.when(minutes.isNotNull(), clamped((minutes * inverse(limits.minutes).cast("double")).cast("float")))
    average = zero("customer.avg_amount").cast("float")
    ratio = F.when(average > 0, ((zero("transaction.amount") / average.cast("double")).cast("float") * inverse(limits.amount_vs_average)).cast("float")).otherwise(single(1.0))
    absent = F.lit(-10_000).cast("smallint")
    flag = lambda c: F.when(F.coalesce(F.col(c), F.lit(False)), 10_000).otherwise(0).cast("smallint")
    known = F.coalesce(F.array_contains("customer.known_merchants", F.col("merchant.id")), F.lit(False))
    return [
        scaled("transaction.amount", limits.amount),
        q16(clamped(zero("transaction.installments", "float") * inverse(limits.installments))),
        q16(clamped(ratio)),
        q16(F.hour(when).cast("float") * inverse(23)),
        q16(F.weekday(when).cast("float") * inverse(6)),
        F.when(last.isNull(), absent).otherwise(q16(since)),
        F.when(last.isNull(), absent).otherwise(scaled("last_transaction.km_from_current", limits.km)),
        scaled("terminal.km_from_home", limits.km),
        q16(clamped(zero("customer.tx_count_24h", "float") * inverse(limits.tx_count_24h))),
        flag("terminal.is_online"),
        flag("terminal.card_present"),
        F.when(known, 0).otherwise(10_000).cast("smallint"),
        risk(F.col("merchant.mcc"), limits.mcc_risk),
        scaled("merchant.avg_amount", limits.merchant_average),
    ]


def vectorized(transactions: DataFrame, limits: Limits = Limits(), name: str = "q16") -> DataFrame:  # noqa: B008
    """All columns of the transactions, and their features as one array of smallint."""
    return transactions.withColumn(name, F.array(*feature_columns(limits)))
