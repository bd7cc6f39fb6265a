"""Readers, writers, generated axes and the test fixtures."""
