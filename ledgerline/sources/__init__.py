"""Ledgerline sources."""
