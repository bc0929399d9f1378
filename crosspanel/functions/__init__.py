"""Part of the panel library."""
