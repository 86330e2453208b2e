"""Readers and writers of edge lists, rankings, grouped and binary rating files."""
