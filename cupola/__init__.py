"""cupola: corpus preparation and leakage-free splitting as Spark jobs."""
