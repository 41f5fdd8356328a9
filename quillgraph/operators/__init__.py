"""Set-based operators over graph tables."""
