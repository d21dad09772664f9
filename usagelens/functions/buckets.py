"""Bucket families of the usage reports.

A family splits an integer measure into ranges.  Bounds are upper-inclusive; where a family has a zero
bucket it holds exactly zero.  Values that no bucket covers (NULL, or zero in a family without a zero
bucket) still count in a group's total.
"""

from __future__ import annotations

from dataclasses import dataclass

from .fixed_point import GB, MB, TB


@dataclass(frozen=True)
class BucketFamily:
    """Upper bounds (the last bucket is open) and the texts of all buckets, in order."""

    bounds: tuple[int, ...]
    texts: tuple[str, ...]
    has_zero_bucket: bool

    def __post_init__(self) -> None:
        if len(self.texts) != len(self.bounds) + 1 + int(self.has_zero_bucket):
            raise ValueError("a family needs one text per bucket")

    @property
    def ordinals(self) -> range:
        first = 0 if self.has_zero_bucket else 1
        return range(first, first + len(self.texts))

    @property
    def labels(self) -> list[str]:
        """Texts led by their ordinal, as the histograms show them."""
        return [f"{i}: {text}" for i, text in zip(self.ordinals, self.texts)]

    def conditions(self, value: str) -> list[str]:
        """One SQL predicate per bucket.

        Plain predicates inside the aggregates compile to small methods; a CASE ladder giving the
        ordinal would be inlined into one method that HotSpot refuses to compile.
        """
        lows = (0, *self.bounds)
        found = [f"{value} = 0"] if self.has_zero_bucket else []
        found += [f"{value} > {low}L AND {value} <= {high}L" for low, high in zip(lows, self.bounds)]
        return [*found, f"{value} > {self.bounds[-1]}L"]


# Bucket bounds and bucket texts are part of the report contract.

LOCAL_SPILL = BucketFamily(
    bounds=(MB, GB, 10 * GB, 100 * GB, TB),
    texts=(
        "LOCAL_SPILLED_SIZE = 0B",
        "0B < LOCAL_SPILLED_SIZE <= 1MB",
        "1MB < LOCAL_SPILLED_SIZE <= 1GB",
        "1GB < LOCAL_SPILLED_SIZE <= 10GB",
        "10GB < LOCAL_SPILLED_SIZE <= 100GB",
        "100GB < LOCAL_SPILLED_SIZE <= 1TB",
        "1TB < LOCAL_SPILLED_SIZE",
    ),
    has_zero_bucket=True,
)

REMOTE_SPILL = BucketFamily(
    bounds=(MB, GB, 10 * GB, 100 * GB, TB),
    texts=(
        "REMOTE_SPILLED_SIZE = 0B",
        "0B < REMOTE_SPILLED_SIZE <= 1MB",
        "1MB < REMOTE_SPILLED_SIZE <= 1GB",
        "1GB < REMOTE_SPILLED_SIZE <= 10GB",
        "10GB < REMOTE_SPILLED_SIZE <= 100GB",
        "100GB < REMOTE_SPILLED_SIZE <= 1TB",
        "1TB < REMOTE_SPILLED_SIZE",
    ),
    has_zero_bucket=True,
)

# Ratios in millionths.
QUEUED_RATIO = BucketFamily(
    bounds=(10_000, 50_000, 200_000, 500_000),
    texts=(
        "ELAPSED_TIME_QUEUED% = 0%",
        "0% < ELAPSED_TIME_QUEUED% <= 1%",
        "1% < ELAPSED_TIME_QUEUED% <= 5%",
        "5% < ELAPSED_TIME_QUEUED% <= 20%",
        "20% < ELAPSED_TIME_QUEUED% <= 50%",
        "50% < ELAPSED_TIME_QUEUED%",
    ),
    has_zero_bucket=True,
)

TXBLOCKED_RATIO = BucketFamily(
    bounds=(10_000, 50_000, 200_000, 500_000),
    texts=(
        "ELAPSED_TIME_TXBLOCKED% = 0%",
        "0% < ELAPSED_TIME_TXBLOCKED% <= 1%",
        "1% < ELAPSED_TIME_TXBLOCKED% <= 5%",
        "5% < ELAPSED_TIME_TXBLOCKED% <= 20%",
        "20% < ELAPSED_TIME_TXBLOCKED% <= 50%",
        "50% < ELAPSED_TIME_TXBLOCKED%",
    ),
    has_zero_bucket=True,
)

# Milliseconds.
ELAPSED = BucketFamily(
    bounds=(1_000, 10_000, 60_000, 600_000, 3_600_000),
    texts=(
        "0s < ELAPSED_TIME <= 1s",
        "1s < ELAPSED_TIME <= 10s",
        "10s < ELAPSED_TIME <= 60s",
        "60s < ELAPSED_TIME <= 600s",
        "600s < ELAPSED_TIME <= 3600s",
        "3600s < ELAPSED_TIME",
    ),
    has_zero_bucket=False,
)

SCAN_SIZE = BucketFamily(
    bounds=(GB, 20 * GB, 50 * GB),
    texts=(
        "0B < SCAN_SIZE <= 1GB",
        "1GB < SCAN_SIZE <= 20GB",
        "20GB < SCAN_SIZE <= 50GB",
        "50GB < SCAN_SIZE",
    ),
    has_zero_bucket=False,
)

# Scanned partitions over all partitions, in millionths.
PRUNE_RATIO = BucketFamily(
    bounds=(10_000, 100_000, 300_000, 600_000, 900_000),
    texts=(
        "0 < SCAN_P_RATIO <= 1%",
        "1 < SCAN_P_RATIO <= 10%",
        "10 < SCAN_P_RATIO <= 30%",
        "30 < SCAN_P_RATIO <= 60%",
        "60 < SCAN_P_RATIO <= 90%",
        "90% < SCAN_P_RATIO",
    ),
    has_zero_bucket=False,
)
