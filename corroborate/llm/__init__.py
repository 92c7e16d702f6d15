"""Training-corpus operators: filtering, deduplication, scoring, packing, sharding."""
