"""Deeply nested posts as related flat tables.

Method: higher-order projection. Nested ``transform`` calls attach the keys and indices of all ancestors to each
element, ``flatten`` combines the arrays of one level, and one ``inline`` per target table emits its rows. Nothing
is exploded twice and nothing is shuffled; a table is one narrow pass over the scan.

Defined cases: a null post, array, element or struct gives no row; an element whose own id or whose holder's id is
null is no link and gives no row in ``links``, but stays in the flat tables with null keys; extra columns of the
input are ignored, whatever their names; repeated rows give repeated rows in the flat tables and one row in ``links``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _each(array: Column, make: Callable[[Column, Column], Column]) -> Column:
    """``make(element, index)`` of every non-null element, in order; a null array counts as empty."""
    kept = F.transform(array, lambda x, i: F.when(x.isNotNull(), make(x, i)))
    return F.coalesce(F.filter(kept, lambda x: x.isNotNull()), F.array())


def _struct(**cols: Column) -> Column:
    return F.struct(*[c.alias(name) for name, c in cols.items()])


def _inline(df: DataFrame, array: Column) -> DataFrame:
    return df.select(F.inline(array))


def posts(raw: DataFrame) -> DataFrame:
    """post rows: row_id, crawled_at, post_id, created_at, text_raw, user_id, screen_name."""
    p = F.col("post")
    return raw.where(p.isNotNull()).select(
        "row_id", "crawled_at", p.id.alias("post_id"), p.created_at.alias("created_at"), p.text_raw.alias("text_raw"),
        p.user.id.alias("user_id"), p.user.screen_name.alias("screen_name"),
    )


def comments(raw: DataFrame) -> DataFrame:
    p = F.col("post")
    return _inline(raw, _each(p.comments, lambda c, i: _struct(
        row_id=F.col("row_id"), post_id=p.id, comment_index=i, comment_id=c.id, text_raw=c.text_raw,
        user_id=c.user.id, screen_name=c.user.screen_name,
    )))


def replies(raw: DataFrame) -> DataFrame:
    p = F.col("post")
    return _inline(raw, F.flatten(_each(p.comments, lambda c, i: _each(c.comments, lambda r, j: _struct(
        row_id=F.col("row_id"), post_id=p.id, comment_index=i, comment_id=c.id, reply_index=j, reply_id=r.id,
        reply_to=r.reply_comment.id, text_raw=r.text_raw, user_id=r.user.id, screen_name=r.user.screen_name,
    )))))


def reposts(raw: DataFrame) -> DataFrame:
    """Repost text is ``text_law`` where that holds any, else ``text_raw``."""
    p = F.col("post")
    return _inline(raw, _each(p.reposts, lambda r, i: _struct(
        row_id=F.col("row_id"), post_id=p.id, repost_index=i, repost_id=r.id,
        text=F.when(F.length(F.trim(r.text_law)) > 0, r.text_law).otherwise(r.text_raw),
        user_id=r.user.id, screen_name=r.user.screen_name,
    )))


def users(raw: DataFrame) -> DataFrame:
    """Every user struct with its holder: kind (post, comment, reply, repost), holder_id, user_id, screen_name."""
    p = F.col("post")

    def one(kind: str, holder: Column, user: Column) -> Column:
        return _struct(row_id=F.col("row_id"), kind=F.lit(kind), holder_id=holder, user_id=user.id, screen_name=user.screen_name)

    whole = F.concat(
        F.array(one("post", p.id, p.user)),
        _each(p.comments, lambda c, i: one("comment", c.id, c.user)),
        F.flatten(_each(p.comments, lambda c, i: _each(c.comments, lambda r, j: one("reply", r.id, r.user)))),
        _each(p.reposts, lambda r, i: one("repost", r.id, r.user)),
    )
    return _inline(raw, F.filter(whole, lambda u: u.user_id.isNotNull() | u.screen_name.isNotNull()))


def links(raw: DataFrame) -> DataFrame:
    """Distinct (post_id, parent_id, node_id, kind) of all rows.

    One aggregation with map-side combine: copies of a post crawled often shrink before the shuffle.
    """
    p = F.col("post")

    def link(kind: str, parent: Column, node: Column) -> Column:
        return _struct(post_id=p.id, parent_id=parent, node_id=node, kind=F.lit(kind))

    whole = F.concat(
        _each(p.comments, lambda c, i: link("comment", p.id, c.id)),
        F.flatten(_each(p.comments, lambda c, i: _each(c.comments, lambda r, j: link("reply", c.id, r.id)))),
        _each(p.reposts, lambda r, i: link("repost", p.id, r.id)),
    )
    found = _inline(raw.select("post"), F.filter(whole, lambda x: x.node_id.isNotNull() & x.parent_id.isNotNull()))
    return found.dropDuplicates()
