"""Training-data operators: search, license and personal-data scans, tokenising, mixing, dedup, quality."""
