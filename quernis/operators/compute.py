"""Eager-style functions over frames: filter, project, group_by and join."""

from __future__ import annotations

from collections.abc import Sequence

from quernis.functions import expr as x
from quernis.operators.frame import Frame


def filter(frame: Frame, predicate: x.Expr) -> Frame:  # noqa: A001
    return frame.filter(predicate)


def project(frame: Frame, exprs: Sequence[x.Expr]) -> Frame:
    return frame.project(*exprs)


def group_by(frame: Frame, keys: Sequence[x.Expr], aggs: Sequence[x.Expr]) -> Frame:
    return frame.group_by(*keys).agg(*aggs) if keys else frame.aggregate(*aggs)


def join(left: Frame, right: Frame, on: Sequence[str], how: str = "inner", suffix: str | None = None) -> Frame:
    return left.join(right, on, how, suffix)
