"""Test-table adapters, registered queries and their SQL counterparts."""
