"""Training-data operators: search, mixing, fingerprints, filters, extraction, linking, near copies, scoring, packing."""
