"""File scans, entity tables, vector collections and the event log."""
