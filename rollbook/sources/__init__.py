"""Workbooks, logs, file tracking, and sinks."""
