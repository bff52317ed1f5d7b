"""A scan with what is to be known about it: when it ran, how long, and what it lost."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from riskloom import rules
from riskloom.plans.scan import scan
from riskloom.plans.summary import repo_summary


@dataclass(frozen=True)
class ScanRun:
    """``results`` of a scan that has ended, and the counts of files it saw (``listed``),
    left out as their size is unknown (``dropped``) or could not read whole (``failed``)."""

    results: DataFrame
    started: datetime
    ended: datetime
    listed: int
    dropped: int
    failed: int

    @property
    def seconds(self) -> float:
        return (self.ended - self.started).total_seconds()

    def summary(self, k: int = rules.REPORT_LIMIT) -> DataFrame:
        """``repo_summary`` with ``scan_started, scan_ended, scan_duration`` (seconds), which
        are those of the whole run: repositories are scanned together."""
        return repo_summary(self.results, k).withColumns({
            "scan_started": F.lit(self.started).cast("timestamp"), "scan_ended": F.lit(self.ended).cast("timestamp"),
            "scan_duration": F.lit(self.seconds),
        })


def run_scan(files: DataFrame, **options) -> ScanRun:
    """``scan(files, **options)``, timed and counted. The contents are read within, so the
    time is that of the work, not of its planning. An empty table counts no file."""
    lost = Observation()
    started = datetime.now(timezone.utc)
    results = scan(files, lost=lost, **options)
    ended = datetime.now(timezone.utc)
    return ScanRun(results, started, ended, **{name: int(n) for name, n in lost.get.items()})
