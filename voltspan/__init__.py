"""voltspan: network and catalog analytics expressed as Spark DataFrame plans."""
