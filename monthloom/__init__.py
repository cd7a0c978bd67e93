"""Entity-month panel analytics expressed as lazy Spark DataFrame transformations."""
