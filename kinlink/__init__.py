"""Record linkage and text-corpus processing on Spark."""
