"""Factloom: evidence-first text, graph and versioned-state analytics on Spark."""
