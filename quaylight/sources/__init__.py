"""Readers and parsing jobs that turn raw files and text columns into event rows."""
