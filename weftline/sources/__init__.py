"""Readers that turn tables and text into crawl records."""
