"""Readers and writers, and generated packets."""
