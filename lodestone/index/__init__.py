"""Indexes written beside a corpus: searches that read and score only what can be among their results."""
