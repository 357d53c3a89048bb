"""Contribution roster jobs and corpus operators as plain PySpark DataFrame functions."""
