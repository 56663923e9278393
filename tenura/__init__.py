"""Survival and churn analysis over behaviour and text, written for Spark DataFrames."""
