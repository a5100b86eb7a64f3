"""Logistics data quality, freight pricing and delay analytics as Spark DataFrame operators."""
