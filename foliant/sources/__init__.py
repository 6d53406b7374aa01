"""Readers of evaluation sets, pages and files, and writers of reports and vectors."""
