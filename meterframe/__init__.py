"""Usage metering, pricing and retention analytics as Spark DataFrame jobs."""
