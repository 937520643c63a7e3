"""Where the columns of a frame come from, read off its analysed plan."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame


def _each(sequence) -> Iterator:
    return (sequence.apply(i) for i in range(sequence.size()))


def _ids(attributes) -> set[int]:
    """Numbers of the attributes in a set of references."""
    return {a.exprId().id() for a in _each(attributes.toSeq())}


def sources(df: DataFrame) -> dict[str, set[str]]:
    """Per column of ``df`` the names, on the way from the scans, that its values pass.

    A column's values come from the columns its expression names. Filters, joins and
    groupings decide which rows there are and are not followed. Where an operator
    gives columns without saying from which (an explosion, Python over batches), each
    may come from all that the operator names.
    """
    names: dict[int, str] = {}
    parents: dict[int, set[int]] = {}
    queue = [df._jdf.queryExecution().analyzed()]
    while queue:
        plan = queue.pop()
        children = list(_each(plan.children()))
        queue += children
        below = [[a.exprId().id() for a in _each(child.output())] for child in children]
        made: set[int] = set()
        for expression in _each(plan.expressions()):
            if expression.nodeName() == "Alias":
                number = expression.exprId().id()
                names[number] = expression.name()
                parents.setdefault(number, set()).update(_ids(expression.references()) - {number})
                made.add(number)
        for place, attribute in enumerate(_each(plan.output())):
            number = attribute.exprId().id()
            names.setdefault(number, attribute.name())
            if plan.nodeName() == "Union":
                parents.setdefault(number, set()).update(ids[place] for ids in below if ids[place] != number)
            elif children and number not in made and not any(number in ids for ids in below):
                parents.setdefault(number, set()).update(_ids(plan.references()) - {number})
    return {
        a.name(): {names[n] for n in _closure(a.exprId().id(), parents) if n in names}
        for a in _each(df._jdf.queryExecution().analyzed().output())
    }


def _closure(start: int, parents: dict[int, set[int]]) -> set[int]:
    seen, queue = set(), [start]
    while queue:
        number = queue.pop()
        if number not in seen:
            seen.add(number)
            queue += parents.get(number, ())
    return seen
