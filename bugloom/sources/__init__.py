"""Scans and sinks: tracker exports, submissions, the knowledge base."""
