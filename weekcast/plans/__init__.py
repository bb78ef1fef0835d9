"""Whole runs: audit, experiment, scenario prediction."""
