"""Bulk loads, exports, backups and table profiles."""
