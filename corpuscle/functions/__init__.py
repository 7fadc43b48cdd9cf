"""Part of corpuscle."""
