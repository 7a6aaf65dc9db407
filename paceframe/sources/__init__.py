"""Readers and writers: JDBC, Kafka, text, JSON and Parquet."""
