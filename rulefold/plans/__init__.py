"""Specs and their application to tables."""
