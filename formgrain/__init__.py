"""Field extraction and validation over tables and streams of recognised document text."""

from .session import get_session, shared_dir

__all__ = ["get_session", "shared_dir"]
