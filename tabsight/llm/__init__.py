"""Operators for preparing language-model training data.

Nothing else in the package imports this subpackage; ``queries.py`` registers one query per
operator. Modules that run Python on the executors are imported there by name, so ship the
package with ``--py-files`` (or install it) on a cluster.
"""
