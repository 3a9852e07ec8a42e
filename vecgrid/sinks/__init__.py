from vecgrid.sinks.writers import (
    append_parquet,
    write_clusters,
    write_csv,
    write_grid,
    write_parquet,
    write_small_json,
)

__all__ = ["append_parquet", "write_clusters", "write_csv", "write_grid", "write_parquet", "write_small_json"]
