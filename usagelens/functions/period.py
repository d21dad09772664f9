"""Report windows.

A window is given in report wall-clock time (Asia/Tokyo by default) and is inclusive at both ends.
Stored times are UTC.  The zone conversion is applied to the two constant bounds and never to the
column, so that Catalyst folds it and the Parquet reader skips row groups outside the window.
"""

from __future__ import annotations

import calendar
from dataclasses import dataclass
from datetime import date, datetime, time, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

REPORT_ZONE = "Asia/Tokyo"
TIME_FORMAT = "%Y-%m-%d %H:%M:%S"

#: Date column that prunes partitions when a history table is stored by day (UTC).
PARTITION_COLUMN = "start_date"


def _ntz(value: datetime) -> Column:
    return F.lit(value.isoformat(sep=" ")).cast("timestamp_ntz")


def _has_instants(df: DataFrame, column: str) -> bool:
    """True for ``timestamp`` (an instant), False for ``timestamp_ntz`` (UTC wall clock)."""
    return isinstance(df.schema[column].dataType, T.TimestampType)


@dataclass(frozen=True)
class Period:
    begin: datetime
    end: datetime
    zone: str = REPORT_ZONE

    @classmethod
    def of(cls, begin: str, end: str, zone: str = REPORT_ZONE) -> Period:
        """From ``YYYY-MM-DD HH:MM:SS`` texts."""
        return cls(datetime.strptime(begin, TIME_FORMAT), datetime.strptime(end, TIME_FORMAT), zone)

    @classmethod
    def between_dates(
        cls,
        begin_date: date,
        end_date: date,
        begin_time: time = time(0, 0),
        end_time: time = time(23, 59),
        zone: str = REPORT_ZONE,
    ) -> Period:
        return cls(datetime.combine(begin_date, begin_time), datetime.combine(end_date, end_time), zone)

    @property
    def label(self) -> str:
        return f"{self.begin:%Y-%m-%d} - {self.end:%Y-%m-%d}"

    def rows_of(self, df: DataFrame, column: str = "start_time") -> DataFrame:
        """Rows whose stored time lies in the window."""
        if _has_instants(df, column):
            # A wall clock in the session zone, cast to the instant it denotes.
            low, high = (
                F.convert_timezone(F.lit(self.zone), F.current_timezone(), _ntz(t)).cast("timestamp")
                for t in (self.begin, self.end)
            )
        else:
            low, high = (
                F.convert_timezone(F.lit(self.zone), F.lit("UTC"), _ntz(t)) for t in (self.begin, self.end)
            )
        return self._days(df).where((F.col(column) >= low) & (F.col(column) <= high))

    def _days(self, df: DataFrame) -> DataFrame:
        """Of a table stored by day, the days that can hold rows of the window."""
        if PARTITION_COLUMN not in df.columns:
            return df
        # Zone offsets are under one day, so a day of slack on both sides never loses a row.
        day = timedelta(days=1)
        return df.where(
            F.col(PARTITION_COLUMN).between(F.lit((self.begin - day).date()), F.lit((self.end + day).date()))
        )

    def days_of(self, df: DataFrame, column: str = "start_time") -> DataFrame:
        """Rows between the midnights of the first and the last day, in stored time.

        This is the window of the credit figures: it is not shifted to the report zone, and of the
        last day it keeps only the instant of midnight.
        """
        kind = "timestamp" if _has_instants(df, column) else "timestamp_ntz"
        low, high = (F.lit(t.date().isoformat()).cast(kind) for t in (self.begin, self.end))
        return self._days(df).where((F.col(column) >= low) & (F.col(column) <= high))

    def local_time(self, df: DataFrame, column: str = "start_time") -> str:
        """SQL expression: the stored time as wall clock of the report zone."""
        stored_zone = "current_timezone()" if _has_instants(df, column) else "'UTC'"
        return f"convert_timezone({stored_zone}, '{self.zone}', CAST({column} AS TIMESTAMP_NTZ))"


def default_period(today: date, zone: str = REPORT_ZONE) -> Period:
    """The month of ``today``: first day 00:00:00 to last day 23:59:00, as the selectors preset it.

    The last 59 seconds of the month are outside.
    """
    last_day = calendar.monthrange(today.year, today.month)[1]
    return Period.between_dates(today.replace(day=1), today.replace(day=last_day), zone=zone)
