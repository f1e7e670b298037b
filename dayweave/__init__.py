"""Activity analytics over sensor histories, expressed as Spark DataFrame operators."""
