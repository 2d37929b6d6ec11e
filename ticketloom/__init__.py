"""Ticket triage, labelling, retrieval and evaluation as Spark DataFrame operators."""

from ticketloom.config import TriageConfig

__all__ = ["TriageConfig"]
