"""Entity resolution and data preparation expressed as Spark DataFrame plans."""
