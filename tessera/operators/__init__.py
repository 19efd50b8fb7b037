"""DataFrame -> DataFrame operators, a module for each group."""
