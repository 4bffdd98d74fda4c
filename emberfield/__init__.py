"""Thermal-inspection analytics expressed as Spark DataFrame operators."""

ENGINE_VERSION = "0.1.0"
