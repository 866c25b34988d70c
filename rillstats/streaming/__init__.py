"""The same declarations over streams."""

from .aggregate import fold_in_order, stream_aggregate, stream_cells

__all__ = ["fold_in_order", "stream_aggregate", "stream_cells"]
