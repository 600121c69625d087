"""Statistical adjustment of time series, and the properties and measures around it, as Spark plans."""
