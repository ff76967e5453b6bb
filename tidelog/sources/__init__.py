"""Readers of log trees, run directories, saved state; writers of tables, exports and archives."""
