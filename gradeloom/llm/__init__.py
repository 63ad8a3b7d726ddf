"""Training-data operators: mixing, revisit resolution, deduplication, search, extraction, tokens, chat and toxicity."""
