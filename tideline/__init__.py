"""Part of the tideline engine."""
