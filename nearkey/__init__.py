"""nearkey: typo-tolerant spatial keyword search and corpus preparation as Spark plans."""
