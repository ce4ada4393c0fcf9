"""Readers of messages, requests and events, and writers of the audit log."""
