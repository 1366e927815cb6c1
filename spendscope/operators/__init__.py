"""DataFrame-in, DataFrame-out operators over the normalised usage table."""
