"""Training-data pipeline operators: tokenising, near-duplicates, language, privacy, packing, toxicity, search, media, web archives, licences."""
