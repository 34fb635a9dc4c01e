"""Detectors: compositions of operators that end in findings."""
