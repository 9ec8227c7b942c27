"""Query registry and end-to-end plans."""
