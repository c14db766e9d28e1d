"""Intentionally empty: the analytics this library covers are batch only.

The one time-like notion they need, a clock that hides the future, is the
``as_of`` column of the as-of joins in :mod:`pitlane.operators.asof`.
"""
