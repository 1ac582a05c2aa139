"""Transit demand analytics as Spark DataFrame plans."""
