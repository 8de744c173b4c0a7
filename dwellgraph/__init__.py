"""Mobility-trace and contact-graph analytics as Spark DataFrame transformations."""
