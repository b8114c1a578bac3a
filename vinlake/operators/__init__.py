"""DataFrame to DataFrame operators: ingest and merges, per-vehicle histories, windows, sets, limits and ledgers."""
