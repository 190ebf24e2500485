import datetime as dt
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from ledgerlife.session import local_session  # noqa: E402
from ledgerlife.sources import schemas  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, "ledgerlife-tests")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def day(text):
    return dt.date.fromisoformat(text)


class Inputs:
    """Small hand-written inputs."""

    def __init__(self, spark):
        self.spark = spark

    def trades(self, rows):
        """Rows of (party, day[, instrument[, orders[, turnover]]])."""
        full = []
        for row in rows:
            party, when, code, orders, turnover = (list(row) + ["EQ", 1, 10.0][len(row) - 2 :])[:5]
            full.append((party, day(when), code, orders, turnover, None if turnover is None else turnover / 100))
        return self.spark.createDataFrame(full, schemas.TRADE_LOG)

    def kyc(self, rows):
        """Dicts of customer columns; a bare number is a B2C party without attributes."""
        names = schemas.CLIENT_KYC.names
        full = []
        for row in rows:
            row = {"party_code": row, "B2C": "Y"} if isinstance(row, int) else row
            full.append(tuple(row.get(name) for name in names))
        return self.spark.createDataFrame(full, schemas.CLIENT_KYC)

    def calendar(self, days):
        return self.spark.createDataFrame([(d if isinstance(d, dt.date) else day(d),) for d in days], schemas.TRADING_DAYS)

    def weekdays(self, first, last, holidays=()):
        first, last = day(first), day(last)
        days = [first + dt.timedelta(n) for n in range((last - first).days + 1)]
        return self.calendar([d for d in days if d.weekday() < 5 and d.isoformat() not in holidays])

    def tiers(self, rows):
        return self.spark.createDataFrame(rows, schemas.CITY_TIER)


@pytest.fixture(scope="session")
def make(spark):
    return Inputs(spark)
