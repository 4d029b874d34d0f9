"""orrery: document, graph and event analytics as DataFrame -> DataFrame operators on Spark."""
