"""Scans and sinks: validated JSON and CSV, API payloads, boundaries, page data, logs, evidence."""
