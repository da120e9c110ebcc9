"""Spare-parts planning and corpus analytics as plain ``DataFrame -> DataFrame`` functions on Spark."""
