"""Readers, sinks and the fixture adapters."""
