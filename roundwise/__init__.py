"""Longitudinal-cohort analytics on Spark DataFrames.

``sources``    readers and sinks
``functions``  column functions: codes, bands, dates, intervals
``operators``  DataFrame -> DataFrame steps: panel, estimates, trends, curves
``plans``      the operators put together: survey tables to panel, fixtures
"""
