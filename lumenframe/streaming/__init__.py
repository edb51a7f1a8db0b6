"""Structured Streaming forms of the activity operators; each agrees with its batch twin once its input is complete."""
