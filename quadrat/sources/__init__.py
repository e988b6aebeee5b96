"""Delimited sources of the study and the tidy table."""
