"""Training-data operators on Spark: rules, scans, mixing, search, joins and packing."""
