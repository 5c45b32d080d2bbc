"""Composite queries and the binding of the driver's test tables to the
roles the operators expect."""
