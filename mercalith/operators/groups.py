"""Attach the rows of a large frame to a table holding one row per key.

The rows stay on the left, the side that adaptive execution can split where a key is frequent
(`session.SESSION_CONF` lets it do so for every join kind used here); the right side has one row
for each key, so nothing multiplies.  A small right side becomes a broadcast by its measured size.

Where few rows have a group (`few`), most others are dropped before the shuffle: the hashes of the keys of
all groups are set bits of a fixed number of words, which go to the rows.  This reads the groups twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

# The bits of all keys: at most WORDS rows of 64 bits, whatever the number of groups.
WORDS = 1 << 20


def _with_a_group(rows: DataFrame, groups: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """`rows` less most of those that have no group: those whose bit no key has set."""
    key = f"xxhash64({', '.join(keys)})"
    place = f"CAST(shiftrightunsigned({key}, 6) & {WORDS - 1} AS INT) AS _word"
    return rows.sparkSession.sql(
        f"""
        SELECT /*+ BROADCAST(b) */ r.* EXCEPT (_word, _bit)
        FROM (SELECT *, {place}, CAST({key} & 63 AS INT) AS _bit FROM {{rows}}) r
        JOIN (SELECT _word, bit_or(shiftleft(1L, _bit)) AS _bits
              FROM (SELECT {place}, CAST({key} & 63 AS INT) AS _bit FROM {{groups}}) GROUP BY _word) b
        ON r._word = b._word AND getbit(b._bits, r._bit) = 1
        """,
        rows=rows,
        groups=groups,
    )


def join_groups(
    rows: DataFrame,
    groups: DataFrame,
    keys: tuple[str, ...],
    how: str = "LEFT SEMI",
    carry: tuple[str, ...] = (),
    *,
    null_safe: bool = False,
    few: bool = False,
) -> DataFrame:
    """Join `rows` to `groups` (unique on the string columns `keys`) by `how`.

    Result: the columns of `rows` and, unless `how` is LEFT SEMI, the `carry` columns of `groups`.
    """
    same = "<=>" if null_safe else "="
    match = " AND ".join(f"r.{k} {same} g.{k}" for k in keys)
    carried = "".join(f", g.{c}" for c in carry)
    if few and how in ("LEFT SEMI", "INNER"):
        rows = _with_a_group(rows, groups, keys)
        # the keys are unique on the right; Spark would move a semi-join below the filter by bits
        how = "INNER"
    return rows.sparkSession.sql(
        f"SELECT r.*{carried} FROM {{rows}} r {how} JOIN {{groups}} g ON {match}",
        rows=rows,
        groups=groups,
    )
