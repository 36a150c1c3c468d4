from evenkeel.streaming.changes import change_stream, edge_table
from evenkeel.streaming.conditions import track_conditions
from evenkeel.streaming.job_steps import job_steps
from evenkeel.streaming.jobs import track_jobs
from evenkeel.streaming.stateless import affected_stream, reconcile_stream
from evenkeel.streaming.suppress import suppress_unchanged
from evenkeel.streaming.writing import start, to_the_end

__all__ = [
    "affected_stream",
    "change_stream",
    "edge_table",
    "reconcile_stream",
    "start",
    "suppress_unchanged",
    "to_the_end",
    "track_conditions",
    "job_steps",
    "track_jobs",
]
