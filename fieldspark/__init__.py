"""Gridded geoscience analytics and ensemble calibration as Spark DataFrame jobs."""
