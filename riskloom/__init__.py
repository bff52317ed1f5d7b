"""Content-risk engine on Spark: scan tables of files, score them, report per repository."""

from riskloom.plans.exports import export_all, export_reports
from riskloom.plans.runs import run_scan
from riskloom.plans.scan import detectors, scan
from riskloom.plans.summary import repo_summary, verdicts

__all__ = ["scan", "run_scan", "detectors", "repo_summary", "verdicts", "export_all", "export_reports"]
