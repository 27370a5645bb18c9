"""Road planning for mountain terrain, expressed as Spark DataFrame operations."""
