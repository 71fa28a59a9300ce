"""Training-data operators: licence scans, token counts, sharding, quality models, dedup, decontamination, tokenizing, chat formatting."""
