"""Readers and writers of scans."""
