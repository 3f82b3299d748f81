"""Reading extracts and tables, writing tables and reports, and the shared scratch folder."""
from psephos.sources.readers import read_extracts, read_table
from psephos.sources.scratch import scratch_folder, stored
from psephos.sources.writers import write_report, write_table

__all__ = [
    "read_extracts", "read_table", "scratch_folder", "stored", "write_report", "write_table",
]
