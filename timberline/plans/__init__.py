"""Tree growers, estimators and the registered queries."""
