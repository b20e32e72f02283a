"""DataFrame-in, DataFrame-out jobs."""
