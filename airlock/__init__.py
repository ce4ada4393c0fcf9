"""Airlock: finding secrets in outgoing messages and auditing the approvals that let them leave, on Spark."""
