"""Ledgerline package."""
