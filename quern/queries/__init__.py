"""Queries over the driver's tables; importing this package registers them."""

from . import changelog, lexical, memory, metadata, planner, search, storage, streams, telemetry, tensors  # noqa: F401
