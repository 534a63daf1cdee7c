"""Lorekeep: a PySpark-native engine for conversational memory."""
