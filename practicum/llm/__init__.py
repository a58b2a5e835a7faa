"""Operators for large text-training pipelines; nothing outside this subpackage imports it."""
