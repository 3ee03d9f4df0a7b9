"""Knowledge-triplet analytics expressed as Spark DataFrame plans."""
