"""Training-data operators: one module an operator, ``queries`` ties them to the tables.

Nothing outside this folder imports it.
"""
