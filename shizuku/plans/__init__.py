"""Query plans: the domain's tables over the driver's, and the registered queries."""
