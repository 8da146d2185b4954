"""DataFrame operators over blocks: layout parsing, spatial joins, ordered merges, folds and planning."""
