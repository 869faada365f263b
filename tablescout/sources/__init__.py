"""Readers and the source abstraction the operators work on."""
