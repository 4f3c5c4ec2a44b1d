"""Vehicle-telemetry analytics on PySpark: validation, ordering, trips, serving and checks as DataFrame operators."""
