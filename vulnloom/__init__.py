"""Advisory-risk analytics as Spark DataFrame transformations."""
