"""Record-to-network analytics as Spark DataFrame plans."""
