"""Training-data operators: ten DataFrame operators and their registered queries."""
