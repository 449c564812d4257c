"""Part of the spindrift engine."""
