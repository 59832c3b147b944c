"""Readers, and the evidence tables that queries derive from the driver's tables."""
