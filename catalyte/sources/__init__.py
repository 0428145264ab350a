"""Readers and writers: contract-checked CSV, versioned tables, run artifacts."""
