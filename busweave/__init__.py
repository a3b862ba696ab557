"""busweave: in-vehicle bus-log analytics as lazy Spark DataFrame plans."""
