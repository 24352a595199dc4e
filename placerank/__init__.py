"""placerank: find and rank similar places to stay, as Spark DataFrame jobs."""
