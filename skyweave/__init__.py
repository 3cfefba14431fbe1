"""Air-quality fusion and exposure metrics as PySpark DataFrame operators."""
