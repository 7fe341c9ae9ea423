"""Readers and writers: journals, snapshots, metric files, walks, and the test views."""
