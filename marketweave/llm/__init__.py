"""Operators of a training-data pipeline (mixing, dedup, quality, packing ...).

Each module holds one operator as a function over DataFrames; ``queries``
registers the whole-table queries. Nothing else in the library imports this
package.
"""
