"""Training-data operators: filtering, deduplication, scoring, token output, mixing, chat rendering, packing."""
