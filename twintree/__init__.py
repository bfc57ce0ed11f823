"""twintree: find duplicate files, records and directory trees with Spark."""

__version__ = "0.1.0"
