"""Spark-native visitor analytics: identity resolution, spatial joins, audits and reports."""
