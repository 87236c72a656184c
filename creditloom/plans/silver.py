"""Silver tables, each written once and read by everything that follows.

Every model reads the written tables of the models before it.  So each join starts from two
plain table scans: sizes are known, small sides are broadcast by measured size, and adaptive
execution can split the partition of a hot customer.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame

from creditloom.operators import features, staging
from creditloom.session import side_by_side, write_stage

PROCESSED_AT = "silver_processed_at"
COMPUTED_AT = "feature_computed_at"


class Silver:
    """The four silver tables of one set of bronze inputs, built on first use."""

    def __init__(
        self,
        loans: DataFrame,
        bureau: DataFrame,
        transactions: DataFrame,
        as_of: dt.date,
        write: Callable[[DataFrame, str], DataFrame] = write_stage,
        monthly: DataFrame | None = None,
    ):
        """``monthly`` is the spend per customer and month, if it need not be made anew."""
        self.bronze_loans = loans
        self.bronze_bureau = bureau
        self.bronze_transactions = transactions
        self.as_of = as_of
        self._write = write
        self._monthly = monthly

    def _built(self, df: DataFrame, name: str, stamp: str) -> DataFrame:
        return self._write(features.audited(df, stamp), name)

    @cached_property
    def stg_loans(self) -> DataFrame:
        return self._built(staging.stg_loans(self.bronze_loans), "stg_loans", PROCESSED_AT)

    @cached_property
    def stg_credit(self) -> DataFrame:
        return self._built(staging.stg_credit(self.bronze_bureau), "stg_credit", PROCESSED_AT)

    def _dti(self) -> DataFrame:
        return features.feat_dti_ratio(self.stg_loans, self.stg_credit)

    def _util(self) -> DataFrame:
        monthly = self._monthly
        if monthly is None:
            monthly = features.monthly_spend(self.bronze_transactions, self.as_of)
        rolled_up = features.customer_txn_agg(monthly, self.as_of)
        return features.feat_credit_util(self.stg_credit, rolled_up)

    @cached_property
    def feat_dti_ratio(self) -> DataFrame:
        return self._built(self._dti(), "feat_dti_ratio", COMPUTED_AT)

    @cached_property
    def feat_credit_util(self) -> DataFrame:
        return self._built(self._util(), "feat_credit_util", COMPUTED_AT)

    def read_once(self) -> dict[str, DataFrame]:
        """All tables for a reader that takes one pass over each: features are not written."""
        side_by_side(lambda: self.stg_loans, lambda: self.stg_credit)
        return {
            "stg_loans": self.stg_loans,
            "stg_credit": self.stg_credit,
            "feat_dti_ratio": features.audited(self._dti(), COMPUTED_AT),
            "feat_credit_util": features.audited(self._util(), COMPUTED_AT),
        }

    def tables(self) -> dict[str, DataFrame]:
        """All tables; models that do not depend on each other are built side by side."""
        side_by_side(lambda: self.stg_loans, lambda: self.stg_credit)
        side_by_side(lambda: self.feat_dti_ratio, lambda: self.feat_credit_util)
        names = ("stg_loans", "stg_credit", "feat_dti_ratio", "feat_credit_util")
        return {name: getattr(self, name) for name in names}
