"""Log incident analytics on Spark: parsing, policies, event-time dedup, incident tables, outbox and reads."""
