"""Grant-reconciliation analytics as lazy Spark DataFrame transformations."""
