"""Readers and writers: domain tables, imports, HTML pages, exports and archives."""
