"""Training-data operators: one module an operator, each with its query and (where SQL can say it) its SQL.

Nothing else in the library imports this subpackage.
"""
