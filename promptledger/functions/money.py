"""Exact money arithmetic.

Token prices are DECIMAL(18,12) per token, costs DECIMAL(18,8) rounded
half-up, sums stay decimal and are cast to DOUBLE only for reporting.
Doubles disagree on rounding ties at the 8th place, decimals do not.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import settings as S

MONEY = T.DecimalType(18, S.MONEY_SCALE)
TOKENS = T.DecimalType(12, 0)


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def token_cost(input_tokens, output_tokens, price_in, price_out) -> Column:
    """In x price_in + out x price_out, rounded to 8 places."""
    raw = (_c(input_tokens).cast(TOKENS) * _c(price_in)
           + _c(output_tokens).cast(TOKENS) * _c(price_out))
    return F.round(raw, S.MONEY_SCALE).cast(MONEY)
