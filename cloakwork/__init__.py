"""De-identification of imaging metadata and clinical reports as Spark jobs."""
