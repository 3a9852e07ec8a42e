from vecgrid.sources.chunks import assign_chunk_id, assign_chunk_id_by_splits, chunk_plan, source_stem
from vecgrid.sources.readers import (
    detect_format,
    expand_inputs,
    file_ledger,
    lost_files,
    read_parquet_lenient,
    read_strings,
    union_tables,
)

__all__ = [
    "assign_chunk_id",
    "assign_chunk_id_by_splits",
    "chunk_plan",
    "detect_format",
    "expand_inputs",
    "file_ledger",
    "lost_files",
    "read_parquet_lenient",
    "read_strings",
    "source_stem",
    "union_tables",
]
