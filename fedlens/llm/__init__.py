"""Data preparation for large language models; nothing outside this package imports it."""
