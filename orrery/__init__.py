"""Search analytics over schema-inferred document collections, expressed as Spark plans."""
