"""Loan-tape verification and training-data operators on Spark DataFrames."""
