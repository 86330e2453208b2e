"""Training-data preparation: scoring, deduplication, formatting and token counting at corpus scale."""
