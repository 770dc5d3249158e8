"""Whole jobs, the test-table adapters and the registered queries."""
