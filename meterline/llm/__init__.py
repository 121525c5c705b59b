"""Training-data operators: deduplication, decontamination, scoring, mixing, packing and archives."""
