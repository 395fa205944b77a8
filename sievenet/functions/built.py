"""Reuse of large column expressions."""

from __future__ import annotations

from functools import wraps

from pyspark import SparkContext


def built_once(make):
    """Build the columns of ``make(*names)`` once per JVM and reuse them.

    Only for expressions over column names: those stay unresolved until a
    frame uses them, so one object serves every frame.  Building a URL parser
    takes thousands of gateway calls, which would otherwise recur per plan.
    """
    cache: dict = {}

    @wraps(make)
    def get(*args):
        key = (id(SparkContext._gateway), args)
        if key not in cache:
            cache[key] = make(*args)
        return cache[key]

    return get
