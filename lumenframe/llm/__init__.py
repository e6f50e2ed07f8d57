"""Training-data operators: deduplication, decontamination, extraction, scanning, scoring and tokenising."""
