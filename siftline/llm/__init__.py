"""Training-data operators: filtering, scoring, deduplication and mixing of document tables."""
