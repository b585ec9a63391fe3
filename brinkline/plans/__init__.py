"""Query catalogue and end-to-end plans."""
