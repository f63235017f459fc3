"""Training-data operators: ten stand-alone steps plus their registered queries.

Nothing outside this folder imports it; deleting it leaves the rest intact.
"""
