"""Road-network hazard, routing and segment-year analytics as Spark DataFrame operators."""
