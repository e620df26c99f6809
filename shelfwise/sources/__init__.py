"""Readers, writers and the stored state of a trained model."""
