"""Weekly demand panels on Spark: build, profile, forecast, compare."""
