"""Mutation-proximity jobs on Spark: functions from DataFrame to DataFrame."""
