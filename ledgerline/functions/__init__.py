"""Ledgerline functions."""
