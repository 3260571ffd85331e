"""An inner join with a table that has one row a key, where a few keys hold much of the other side."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot if it has more than one in so many of all rows; so there are fewer hot keys than this.
SHARE = 1000


def join_one(many: DataFrame, one: DataFrame, keys: list[str], weight: str, total: int) -> DataFrame:
    """many with the columns of `one`, whose column `weight` says how many rows of `many` a key has; they sum up to `total`.

    Hot keys, fewer than SHARE whatever the tables' sizes, are broadcast, so their rows stay where they are. The others
    are joined by a shuffle in which no key has more than one in SHARE of the rows. Null keys join nothing.
    """
    hot = F.col(weight) * SHARE > total
    few = F.broadcast(one.where(hot))
    rest = many.join(F.broadcast(one.where(hot).select(*keys)), keys, "left_anti")
    return many.join(few, keys).unionByName(rest.join(one.where(~hot), keys))
