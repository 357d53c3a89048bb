"""Part of the contribution roster jobs."""
