"""Record feeds as Structured Streaming jobs."""

from recordmill.streaming.feeds import run_available, run_for

__all__ = ["run_available", "run_for"]
