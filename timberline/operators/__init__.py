"""DataFrame operators of tree analytics."""
