"""A Spark-native engine for healthcare EDI: files to events, aggregates, deltas and balances."""
