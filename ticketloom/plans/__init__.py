"""Whole flows composed from operators: corpus build, triage, evaluation."""
