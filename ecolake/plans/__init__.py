"""Whole jobs composed of readers, operators and sinks, and the registered queries."""
