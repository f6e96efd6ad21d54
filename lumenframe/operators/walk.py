"""Predicates over property trees: tests of leaves, put together with and, or, not, and evaluated in one pass over the long table.

A ``Test`` is about leaves: ``leaves`` gives those that hold.  A ``Tree`` asks of a whole tree whether some, all or none of its leaves pass a test; these combine
again, and ``owners`` evaluates the whole expression with one conditional aggregate for each question, in one grouping by owner.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenframe.functions import convert as C


@dataclass(frozen=True)
class Test:
    """A condition on a leaf; ``column`` gets a function from names to columns of the tree."""

    column: Callable[[], Column]

    def __and__(self, other: Test) -> Test:
        return Test(lambda: self.column() & other.column())

    def __or__(self, other: Test) -> Test:
        return Test(lambda: self.column() | other.column())

    def __invert__(self) -> Test:
        return Test(lambda: ~self.column())

    def some(self) -> Tree:
        """A leaf passes."""
        return Tree((self,), lambda hits, n: hits[0] > 0)

    def all(self) -> Tree:
        """Every leaf passes (also of an empty selection)."""
        return Tree((self,), lambda hits, n: hits[0] == n)

    def count(self, holds: Callable[[Column], Column]) -> Tree:
        """The number of leaves that pass fulfils a condition."""
        return Tree((self,), lambda hits, n: holds(hits[0]))


@dataclass(frozen=True)
class Tree:
    """A condition on a whole tree: its questions, and how their answers (numbers of leaves that pass, and of all leaves) combine."""

    tests: tuple[Test, ...]
    holds: Callable[[list[Column], Column], Column]

    def _with(self, other: Tree, both: Callable[[Column, Column], Column]) -> Tree:
        k = len(self.tests)
        return Tree(self.tests + other.tests, lambda hits, n: both(self.holds(hits[:k], n), other.holds(hits[k:], n)))

    def __and__(self, other: Tree) -> Tree:
        return self._with(other, lambda a, b: a & b)

    def __or__(self, other: Tree) -> Tree:
        return self._with(other, lambda a, b: a | b)

    def __invert__(self) -> Tree:
        return Tree(self.tests, lambda hits, n: ~self.holds(hits, n))


def _sure(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def path(name: str) -> Test:
    """The leaf at a path, whatever its case."""
    return Test(lambda: F.col("path_lc") == name.lower())


def under(branch: str) -> Test:
    """Leaves of a branch."""
    return Test(lambda: F.startswith(F.col("path_lc"), F.lit(branch.lower().rstrip("/") + "/")))


def like(pattern: str) -> Test:
    """Leaves whose lower-case path fits a regular expression."""
    return Test(lambda: _sure(F.col("path_lc").rlike(pattern)))


def of_type(*names: str) -> Test:
    return Test(lambda: _sure(F.col("type").isin(*names)))


def empty() -> Test:
    """Properties without a value."""
    return Test(lambda: F.col("value").isNull())


def needed(names: tuple[str, ...]) -> Test:
    return Test(lambda: F.col("path_lc").isin(*[n.lower() for n in names]))


def is_list() -> Test:
    """Leaves of a path that has more than one value."""
    return Test(lambda: F.col("__len") > 1)


def equals(text: str) -> Test:
    return Test(lambda: _sure(F.col("value") == text))


def number(holds: Callable[[Column], Column]) -> Test:
    """The value is a number and fulfils a condition."""
    return Test(lambda: _sure(holds(C.parse_double(F.col("value")))))


def anything() -> Test:
    return Test(lambda: F.lit(True))


def _measured(tree: DataFrame) -> DataFrame:
    return tree.withColumn("__len", F.count(F.lit(1)).over(Window.partitionBy("owner", "path_lc")))


def _asks_length(tests: tuple[Test, ...]) -> bool:
    return any("__len" in str(t.column()) for t in tests)


def leaves(tree: DataFrame, test: Test) -> DataFrame:
    """The leaves that pass.  Lists are measured only if the test asks for it; without that nothing is shuffled."""
    d = _measured(tree) if _asks_length((test,)) else tree
    return d.filter(test.column()).select(*tree.columns)


def owners(tree: DataFrame, predicate: Tree, every: DataFrame | None = None) -> DataFrame:
    """(owner, holds) of each tree; owners of ``every`` without a leaf count as empty trees."""
    # lists are measured by owner, so that this and the grouping share one exchange
    d = tree
    if _asks_length(predicate.tests):
        d = tree.repartition("owner")
        d = d.withColumn("__len", F.count(F.lit(1)).over(Window.partitionBy("owner", "path_lc")))
    hits = d.groupBy("owner").agg(F.count(F.lit(1)).alias("__n"), *[F.count_if(t.column()).alias(f"__h{i}") for i, t in enumerate(predicate.tests)])
    n, answers = F.col("__n"), [F.col(f"__h{i}") for i in range(len(predicate.tests))]
    if every is not None:
        hits = every.select("owner").distinct().join(hits, "owner", "left").na.fill(0, ["__n", *[f"__h{i}" for i in range(len(predicate.tests))]])
    return hits.select("owner", predicate.holds(answers, n).alias("holds"))
