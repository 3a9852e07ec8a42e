from vecgrid.streaming.incremental import (
    assign_stream,
    file_stream,
    moments_stream,
    project_stream,
    read_moments,
    read_sketches,
    sketch_stream,
)

__all__ = [
    "assign_stream",
    "file_stream",
    "moments_stream",
    "project_stream",
    "read_moments",
    "read_sketches",
    "sketch_stream",
]
