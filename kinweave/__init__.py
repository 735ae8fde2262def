"""Kinweave: linking units between two tables of different periods, on Spark DataFrames."""

__version__ = "0.1.0"
