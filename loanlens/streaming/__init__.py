"""Structured Streaming versions of the scoring and monitoring plans."""

from loanlens.streaming.scoring import (  # noqa: F401
    REQUEST_STREAM_SCHEMA, score_requests_frame, start_scoring, dedupe_predictions, daily_grade_counts_stream,
)
