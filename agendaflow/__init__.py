"""Event-listing extraction, reconciliation and analytics as Spark DataFrames."""
