"""Composed jobs: the driver-table adapter, the flagship preprocessing job and the
query registry used by ``__spark_entry__``."""
