"""The per-player state of operators on streams of ticks."""
