"""Readers and writers: record files, feature tables, redundant sets, reports."""
