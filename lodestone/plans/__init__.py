"""Registered queries, each with oracle SQL where SQL can express it."""
