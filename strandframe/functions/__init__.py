"""Part of strandframe."""
