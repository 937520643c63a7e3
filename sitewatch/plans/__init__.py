"""Registered queries, their oracle SQL, and the batch jobs."""
