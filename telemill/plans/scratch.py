"""Where queries that write put their tables."""

from telemill.sources.shared import kept, scratch

__all__ = ["kept", "scratch"]
