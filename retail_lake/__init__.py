"""Retail analytics as Spark jobs: ingest, silver/gold tables, features, forecasts, anomalies and text retrieval."""
