"""DataFrame operators over crawl records."""
