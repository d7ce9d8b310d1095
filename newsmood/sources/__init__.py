"""Landed payloads and files to article rows, and article rows to files."""
