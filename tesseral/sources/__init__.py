"""Readers and writers of variant files, sequences, observations and plots."""
