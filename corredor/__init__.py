"""corredor: transit analytics expressed as Spark DataFrame, SQL, streaming and ML jobs."""
