from hitfeed.sinks.csv import CSV_WRITE_OPTIONS, write_csv, rename_single_output

__all__ = ["CSV_WRITE_OPTIONS", "write_csv", "rename_single_output"]
