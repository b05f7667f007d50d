"""Readers and writers for record-delimited, block, index, log and report files."""
