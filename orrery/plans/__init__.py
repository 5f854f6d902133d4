"""Distributed passes, driver-side solvers, pipelines and their rewriting."""
