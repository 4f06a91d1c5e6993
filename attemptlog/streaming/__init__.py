"""Streaming entry points.

The analyses work on finished logs: an attempt's place, its task's best score and every
statistic depend on all attempts of the task.  For logs that arrive as files,
:func:`attempt_stream` reads the folder with Structured Streaming and
:func:`write_row_wise` appends what row-wise operators make of it.
"""

from attemptlog.streaming.files import attempt_stream, write_row_wise  # noqa: F401
