"""Readers, writers and payload packing for sensor logs."""
