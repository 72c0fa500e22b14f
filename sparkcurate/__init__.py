"""sparkcurate: dataset curation as Spark DataFrame jobs."""
