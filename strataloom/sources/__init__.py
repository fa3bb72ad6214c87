"""Scans: source trees, commit logs, document and code chunkers."""
