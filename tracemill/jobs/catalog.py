"""All queries over the driver's tables, and the SQL that each must agree with."""

from __future__ import annotations

from tracemill.jobs import grid_jobs, pipeline_jobs, recording_jobs, relation_jobs, roi_jobs, statistics_jobs, stimulus_jobs, stream_jobs, trace_jobs  # noqa: F401  (they register their queries)
from tracemill.jobs.registry import ORACLES, QUERIES, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
