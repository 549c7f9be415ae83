"""Analytics over 2-D engineering drawings, expressed as Spark DataFrame plans."""
