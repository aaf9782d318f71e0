"""Readers, keyed tables and versioned stores."""
