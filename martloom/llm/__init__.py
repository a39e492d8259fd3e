"""Operators for preparing language-model training text.

One module per operator, each with its own query over the test tables at its
end; ``queries`` gathers them. Nothing outside this package imports it.
"""
