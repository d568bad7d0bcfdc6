"""Spark jobs for the data work behind document search and question answering.

Every operator takes DataFrames (many documents, many queries) and returns a
DataFrame; Catalyst and AQE choose the physical strategy.
"""
