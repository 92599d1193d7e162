"""Structured Streaming jobs (ingest, daily cost, verdict join, alerts, export)."""
