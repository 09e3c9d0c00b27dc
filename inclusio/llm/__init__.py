"""Training-data operators: ten stand-alone DataFrame operators, their queries and SQL."""
