"""Delivery-time analytics as Spark DataFrame operators."""
