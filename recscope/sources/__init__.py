"""Sources: trace journals as a Spark data source, and the decoding of their metadata and payloads."""
