"""The query catalogue: DataFrame plans and their SQL twins."""
