"""Spark-native engine that prepares, orders, mixes and audits language-model corpora."""

__version__ = "0.1.0"
