"""tidewatch: behavioural anomaly analytics on Spark DataFrames."""
