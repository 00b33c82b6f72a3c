"""Road-traffic analytics as Spark DataFrame pipelines."""
