"""Training-data operators: dedup, filtering, decontamination, extraction and packing."""
