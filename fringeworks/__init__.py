"""Calibration analytics on Spark: visibility tables, flags, statistics, gains and solutions."""
