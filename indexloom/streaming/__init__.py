"""Programs over streams of input arrays."""

from .batches import stream, stream_files

__all__ = ["stream", "stream_files"]
