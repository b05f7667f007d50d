"""recordmill: record-structured data processing as ordinary Spark jobs."""

from recordmill.session import checkpoint_dir, get_session

__all__ = ["checkpoint_dir", "get_session"]
