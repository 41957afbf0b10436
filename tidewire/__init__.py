"""Financial-message analytics as Spark DataFrame transformations."""
