"""Factloom: periodic measure facts on Spark.

Wide tables and event-level records become one long fact table (entity, fiscal
period, measure, bucket, value, window basis); every question is a DataFrame
operator over that table.  Nothing in the package creates a Spark session.
"""
