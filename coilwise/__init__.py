"""coilwise: surface-inspection analytics expressed as PySpark jobs."""
