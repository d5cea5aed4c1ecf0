"""Ledgerline llm."""
